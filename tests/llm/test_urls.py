"""URL filters against regular expressions, and the cases that the docstring defines."""

import random
import re

import numpy as np

from wingbeat.llm import queries, urls

ODD = ["*", "**", "*a*", "**a**b", "*.org/**", "a*", "", "*.x.org/en/1**", "*aab**", "**/" + "ab" * 40 + "/**", "*" + "a" * 63, "*" + "b" * 64 + "**", "ab?c**", "**é*"]


def fits(automaton, texts):
    raw = [t.encode() for t in texts]
    return automaton.fits(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def test_automaton_is_the_regular_expressions():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "b", "/", "?", ".", "org", "/en/1", "é", "ab" * 40, "a" * 62]) for _ in range(rnd.randint(0, 9))) for _ in range(1500)] + [""]
    automaton = urls.Automaton(ODD + list(urls.GLOBS))
    assert automaton.words > 4
    found = fits(automaton, texts)
    for i, g in enumerate(ODD + list(urls.GLOBS)):
        shape = re.compile(queries.glob_regex(g).removesuffix("$") + r"\Z")
        assert [bool(x) for x in found[:, i]] == [shape.search(t) is not None for t in texts], g


def test_few_long_ones_are_read_on():
    texts = [".a.org/" + "x" * 200_000 + end for end in ("", ".exe")] + [".b.org/y"] * 40
    found = fits(urls.Automaton(["*.org/**", "**.exe", "*.b.org/*"]), texts)
    assert found[0].tolist() == [True, False, False] and found[1].tolist() == [True, True, False] and found[41].tolist() == [True, False, True]


def plain(url, rules, globs):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    host, path, query = (m[1], m[2], m[3] or "") if m else ("", "", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    other = "block" if any(re.search(queries.glob_regex(g).removesuffix("$") + r"\Z", "." + host + path + query) for g in globs) else "allow"
    return host, path, best and best[1], best[0] if best else other


def test_judged(spark):
    given = [
        None, "", "no address", "http://", "http:///en/1", "https://Example.ORG/en/1?x=://y", "http://a.example.org/es/", "http://a.example.org/ES/", "http://aexample.org/es/2", "http://example.org", "http://example.org?u=b.org/",
        "http://x.com/fr/1#/de/", "http://x.com/de/", "http://cheap-pills.example.com/en/1", "http://cheap-pills.example.com/fr/1", "ftp://a.net/b.exe", "http://a.net/?q=casino", "http://casino.net", "http://ÄB.Org/en/1", "http://example.org:80/es/", "a\nb://c.org/\n",
        "http://a.net/" + "x" * 100_000 + ".zip", "http://u@casino.org/x",
    ]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(given + given[5:7])] + [(None, "http://a.org/", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages).collect()}
    assert out == {i: plain(u, urls.RULES, urls.GLOBS) for i, u, *_ in rows}
    assert urls.judged(pages.limit(0)).count() == 0


def test_ties_and_own_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.bb/cc/d"), (2, "http://a.bb/")], "page_id long, url string")
    out = urls.judged(pages, (("allow", "bb/cc/"), ("block", "a.bb/c")), (), "block").orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in out] == [("a.bb/c", "block"), (None, "block")]
    for bad in ("org", "/x", "a*.org/", "Org/", "org/a?b"):
        try:
            urls.rule_glob(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
