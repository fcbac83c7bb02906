"""The queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from . import alignment, decontaminate, html, infill, jaccard, language, mixing, neighbours, pii, quality, repeats, toxicity, urls

QUERIES: dict[str, Callable] = {}
for _module in (quality, neighbours, toxicity, language, html, repeats, decontaminate, jaccard, pii, mixing, urls, alignment, infill):
    QUERIES |= _module.QUERIES



def glob_regex(glob: str) -> str:
    """The regular expression of a glob of urls.py."""
    return "(?s)^" + re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/?]*").replace(r"\-", "-") + "$"


def _url_sql() -> str:
    """The longest rule of host and path, else whether any glob fits."""
    cut = lambda i: f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?', {i}), '')"
    cases = []
    for verdict, rule in sorted(urls.RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    listed = " OR ".join(f"regexp_matches('.' || host || path || query, '{glob_regex(g)}')" for g in urls.GLOBS)
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    return f"""
        WITH a AS (SELECT page_id, {cut(1)} AS host, {cut(2)} AS path, {cut(3)} AS query FROM pages),
        b AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, query FROM a)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM b"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    # a word is removed when a 50-word window over it also starts in a document of smaller id
    "op6_repeats": rf"""
        WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50),
        h AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS key FROM p),
        f AS (SELECT key, min(doc_id) AS first FROM h GROUP BY key),
        s AS (SELECT h.doc_id, h.pos FROM h JOIN f ON h.key = f.key WHERE f.first < h.doc_id),
        g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM s),
        k AS (SELECT w.doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
        r AS (SELECT k.doc_id, k.word, k.i FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.i = g.i WHERE g.i IS NULL),
        t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM r GROUP BY doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
        FROM w LEFT JOIN t ON w.doc_id = t.doc_id""",
    "op11_url_filter": _url_sql(),
    # seeded cuts between tokens, and the text rebuilt from the output alone
    "op13_infill": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || doc_id) AS h FROM documents),
        d AS (SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c),
        o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output FROM p)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o""",
}
