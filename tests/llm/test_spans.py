"""Personal data against a plain version of the base rules, and what the classifier adds."""

import hashlib
import random
import re
import time

from wingbeat.llm import pii

DOC = "doc_id long, text string"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m.group())]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def texts():
    rng = random.Random(12)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5", "00001.2.3.4", "4929348385146306", "4929 3483 8514 6306", "4929-3483-8514-6307", "12345678901234567890", "+1 (132) 555-1352", "+", "+12", "+1 2", "é", "😀", "word", "call", "ip", ".", "-", "(132) 555-1352", "jo at mail dot org", "jo [at] mail [dot] org"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", "  ", ",", "\n"]) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", " "]


def test_base_spans(spark):
    rows = list(enumerate(texts())) + [(3, "again 1.2.3.4")]
    df = spark.createDataFrame([(*r, "x", [1]) for r in rows], DOC + ", found string, row array<int>")
    want = sorted((i, plain(t)) for i, t in rows)
    got = sorted((r.doc_id, sorted([(x.kind, x.start, x.end) for x in r.found if x.strict], key=lambda x: (x[1], pii.KINDS.index(x[0])))) for r in pii.spans(df).collect())
    assert got == want
    masked = pii.mask(df)
    assert masked.columns == df.columns
    for r in masked.collect():
        assert (r.text is None) == (dict(rows).get(r.doc_id, "") is None)
    assert pii.spans(df.limit(0)).count() == pii.mask(df.limit(0)).count() == 0


def test_mask(spark):
    for text, want in [("a.b@c.de, 1.2.3.4", "[email], [ip]"), ("no", "no"), ("é 1.2.3.4é", "é [ip]é")]:
        assert pii.mask(spark.createDataFrame([(None, text)], DOC)).first().text == want


def test_many_spans(spark):
    """The work follows the number of spans, not its square; runs of folds join right."""
    text = " ".join(f"u{i}@h{i}.org (132) 555-{i % 10000:04d}" for i in range(6000))
    began = time.time()
    r = pii.spans(spark.createDataFrame([(1, text)], DOC)).first()
    base = [(x.kind, x.start, x.end) for x in r.found if x.strict]
    assert base == plain(text) and len(base) == 6000
    assert time.time() - began < 60
    strict = sorted((x.start, x.end) for x in r.accepted if x.strict)
    added = sorted((x.start, x.end) for x in r.accepted if not x.strict)
    assert all(b <= c or d <= a for (a, b), (c, d) in zip(strict, added, strict=False))
    masked = pii.mask(spark.createDataFrame([(1, text)], DOC)).first().text
    assert masked.count("[email]") == 6000 and "@" not in masked


def test_classifier_adds_and_spares(spark):
    """Written-out addresses and national numbers beside many strict ones are added; dates, sums and versions aren't."""
    rows = [(i, f"mail jo{i}@mail{i}.org or call +1 (132) 555-{1000 + i}") for i in range(200)]
    rows += [(1000 + i, f"contact jo{i} [at] mail{i} [dot] org , tel (132) 555-{1000 + i} now") for i in range(20)]
    rows += [(2000, "met at noon dot com boom 2024-01-02 12:30 v1.2.3 sum 1 200 300 page 132"), (2001, "look at this. then 555 1352")]
    got = {r.doc_id: {x.kind for x in r.accepted if not x.strict} for r in pii.spans(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[1000 + i] == {"email", "phone"} for i in range(20))
    assert not got[2000] & {"ip", "card", "phone"} and not got[2001]
    assert not any(got[i] for i in range(200))


def test_digest(spark, tmp_path):
    rows = [(i, t, None) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, DOC + ", source string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        base = plain(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))| ({""} if not base else set())


def test_other_forms(spark):
    """Forms beyond the strict rules, planted beside look-alikes: how many are found, and how many of those added are right."""
    rng = random.Random(21)
    n = lambda k: "".join(rng.choice("123456789") for _ in range(k))

    def card(sep):
        while True:
            if luhn(d := "4" + n(15)):
                return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    forms = [
        lambda: ("email", "mail", f"jo{n(3)} [at] mail{n(2)} [dot] org"), lambda: ("email", "contact", f"jörg{n(3)}@müller{n(2)}.de"), lambda: ("email", "to", f"ana{n(3)}(at)casa{n(2)}(dot)es"),
        lambda: ("ip", "host", f"10[.]{rng.randrange(256)}[.]7[.]{rng.randrange(256)}"), lambda: ("ip", "server", f"2001:db8::{n(3)}:{n(2)}"), lambda: ("ip", "address", "2001:db8:" + ":".join(n(3) for _ in range(6))),
        lambda: ("card", "card", card(".")), lambda: ("card", "visa", card("/")),
        lambda: ("phone", "tel", f"01 {n(2)} {n(2)} {n(2)} {n(2)}"), lambda: ("phone", "call", f"({n(3)}) {n(3)}-{n(4)}"), lambda: ("phone", "phone", f"020 {n(4)} {n(4)}"), lambda: ("phone", "telefon", f"0{n(3)}/{n(7)}"),
    ]
    decoys = [lambda: f"sum 6{n(2)} {n(3)} {n(3)} paid", lambda: f"std::ad::be {n(3)}", lambda: f"at 12:{n(2)}:{n(2)} on 2024-01-{n(1)}", lambda: f"v{n(1)}.{n(1)}.{n(2)}", lambda: f"code {n(4)}.{n(4)}", lambda: f"met at noon{n(2)} then", lambda: f"page {n(3)}/{n(3)}"]
    rows, want = [], set()
    for i in range(600):
        text = f"mail jo{n(4)}@mail{n(2)}.org , host {rng.randrange(1, 250)}.{rng.randrange(256)}.1.2 , card {card(' ')} , call +1 ({n(3)}) 555-{n(4)} "
        if i % 3 == 0:
            for form in forms:
                kind, before, value = form()
                text += f", {before} "
                want.add((i, kind, len(text), len(text) + len(value)))
                text += value + " "
        else:
            text += " ".join(f() for f in decoys)
        rows.append((i, text))
    added = {(r.doc_id, x.kind, x.start, x.end) for r in pii.spans(spark.createDataFrame(rows, DOC)).collect() for x in r.accepted if not x.strict}
    missed = {dict(rows)[i][a:b] for i, _, a, b in sorted(want - added)[:40]}
    wrong = {dict(rows)[i][a:b] for i, _, a, b in sorted(added - want)[:40]}
    assert len(added & want) >= 0.95 * len(want), missed
    assert len(added & want) >= 0.98 * len(added), wrong
