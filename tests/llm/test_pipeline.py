"""The classifiers on held-out rows, and each pipeline stage against a plain version of what it decides."""

import random
import re

import pytest
from test_jaccard import plain
from test_spans import plain as plain_spans

import corpus_pipeline
from wingbeat.llm import quality, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


def made():
    """Prose; junk (repeated capitals and signs); toxic prose (words of its own); near copies; leaks; personal data; odd rows."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(34)) + ". " + " ".join(prose(5)) + ".") for i in range(12)]
    rows, labels = [], []
    for i in range(900):
        w, good, toxic = prose(rng.randrange(50, 120)), 1, 0
        if i % 5 == 1:
            w, good = [rng.choice(["BUY", "NOW", "CLICK", "!!!", "$$$", "FREE"]) for _ in range(40)], 0
        elif i % 9 == 2:
            for k in range(0, len(w), 6):
                w[k] = f"vile{rng.randrange(12)}"
            toxic = 1
        elif i % 50 == 3:
            w[30:30] = items[i // 50 % 12][1].split()
        elif i % 40 == 4:
            w[10:10] = [f"a{i}@b.org", "call", "+1", "(132)", f"555-{1000 + i}"]
        rows.append((i, " ".join(w), "en", "s" + str(i % 3), 0))
        if i % 3:
            labels.append((i, good, toxic))
    for i in range(900, 960):  # near copies of clean rows
        w = rows[5 * (i - 900)][1].split()
        w[len(w) // 2] = "other"
        rows.append((i, " ".join(w), "en", None, 0))
    rows += [(1000, None, None, "s0", None), (1001, "", "en", "s1", 0), (1002, "one", "en", "s1", 3), (None, " ".join(prose(60)), None, None, None), (7, rows[7][1], "en", "s9", 0), (1003, " ".join(prose(30000)), "en", "s2", 0)]
    return rows, labels, items


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rows, labels, items = made()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, spark.read.parquet(f"{d}/documents.parquet"), rows, dict(items)


def test_classifiers(spark, given):
    d, _, rows, _ = given
    truth = {i: (0 if i % 5 == 1 else 1, int(i % 9 == 2 and i % 5 != 1)) for i in range(900)}
    for query, k in ((quality.op1_quality, 0), (toxicity.op3_toxicity, 1)):
        out = query(spark, d).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        held = [r for r in out if r.held_out and r.doc_id in truth]
        wrong = [r for r in held if r.predicted != truth[r.doc_id][k]]
        assert len(held) > 100 and len(wrong) <= 0.03 * len(held)
        again = {(r.doc_id, r.score) for r in query(spark, d).collect()}
        assert again == {(r.doc_id, r.score) for r in out}


def test_nothing_to_learn(spark, given):
    _, docs, _, _ = given
    none = spark.createDataFrame([(1, None, None, 0.1)], LABEL + ", score double")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        scores = {round(r.score, 6) for r in quality.digest(docs, module.train(docs, none, label), 0.5).collect()}
        assert scores == ({0.5} if label == "quality" else {0.0})
    assert quality.keep_good(docs.limit(0), none).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, given):
    d, docs, rows, items = given
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "personal_data", "mix"]
    key = lambda r: (r.doc_id or -1, r.text or "")
    before = sorted(docs.collect(), key=key)
    for name, stage in corpus_pipeline.STAGES:
        path = f"{d}/after-{name}"
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        after = sorted(docs.collect(), key=key)
        if name != "mix":
            assert docs.columns == [c.split()[0] for c in DOC.split(", ")]
        if name == "quality":  # junk goes, prose stays
            junk = {r.doc_id for r in before if words(r.text) and set(words(r.text)) <= {"BUY", "NOW", "CLICK", "!!!", "$$$", "FREE"}}
            kept = {r.doc_id for r in after}
            assert not kept & junk and len({r.doc_id for r in before if len(words(r.text)) > 20} - junk - kept) <= 5
        elif name == "near_copies":
            unique = {r.doc_id: r.text for r in before if r.doc_id is not None}
            first = {c for _, _, c in plain(list(unique.items()), 5, 80)}
            assert sorted((r.doc_id, r.text) for r in after if r.doc_id is not None) == sorted((i, unique[i]) for i in first)
            assert [r.text for r in after if r.doc_id is None] == [r.text for r in before if r.doc_id is None]
        elif name == "decontaminate":
            leak = {r.doc_id for r in before if any(t in (r.text or "") for t in items.values())}
            assert leak and {r.doc_id for r in after} == {r.doc_id for r in before} - leak
        elif name == "personal_data":
            assert len(after) == len(before) and sum(len(plain_spans(r.text)) for r in before) > 10
            for a, b in zip(sorted(before, key=lambda r: r.doc_id or -1), sorted(after, key=lambda r: r.doc_id or -1), strict=True):
                text, at = "", 0
                for kind, start, end in plain_spans(a.text):
                    text, at = text + (a.text[at:start] + f"[{kind}]" if start >= at else ""), max(at, end)
                assert (b.text or "") == text + (a.text or "")[at:]
        else:
            size = {}
            for r in after:
                n, s = len(words(r.text)), size.setdefault(r.source, [0, 0])
                assert 0 <= r.taken <= 3 * n
                size[r.source] = [s[0] + n, s[1] + r.taken]
            total, order = sum(n for n, _ in size.values()), sorted(size, key=lambda s: (s is None, s or ""))
            weight, target, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set()
            while True:
                left = total - sum(3 * size[s][0] for s in capped)
                target = {s: 3 * size[s][0] if s in capped else left * weight[s] / sum(weight[z] for z in order if z not in capped) for s in order}
                more = {s for s in order if s not in capped and target[s] > 3 * size[s][0]}
                if not more:
                    break
                capped |= more
            assert all(abs(size[s][1] - target[s]) <= 16 for s in order)
        before = after


def test_empty(spark, given):
    d, docs, _, _ = given
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name
