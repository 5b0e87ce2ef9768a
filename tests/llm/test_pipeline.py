"""The pipeline's stages against brute force on the smallest tables."""

import os

import numpy as np
import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as c

    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in c.STAGES:
        before, docs = docs, c.materialize(stage(spark, docs, FOLDER), name)
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(after.columns == columns for _, _, after in stages[:-1])


def brute_near_copies(texts, at_least=0.8):
    """Group of each text by chains of five-word shingle sets of that Jaccard similarity."""
    from tidewatt.llm.components import local_components

    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (len(a & b) >= at_least * len(a | b) if a | b else True)]
    return local_components(len(texts), *np.array(links, "i8").reshape(-1, 2).T)


def test_near_duplicates_keep_one_of_each_group(stages):
    _, before, after = stages[1]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    label = brute_near_copies([t for _, t in rows])
    want = {rows[i][0] for i in set(label.tolist())}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == want


def edited(words, share, rng):
    out = list(words)
    for at in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[at] = f"e{rng.integers(0, 10**9)}"
    return " ".join(out)


def test_near_copies_of_one_text_meet_through_it(spark):
    from tidewatt.llm.nearcopies import without_near_copies

    rng = np.random.default_rng(9)
    made, group = [], []
    for g in range(40):
        words = [f"w{x}" for x in rng.integers(0, 3000, 250)]
        for k in range(25 if g == 0 else 1 + g % 4):
            made.append(" ".join(words) if k == (3 if g == 0 else 0) else edited(words, 0.02, rng))
            group.append(g)
    order = rng.permutation(len(made))
    texts = [made[i] for i in order]
    df = spark.createDataFrame([(int(i), t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, node string, root int, fp string").repartition(3)
    kept = without_near_copies(df)
    label = brute_near_copies(texts)
    assert kept.columns == df.columns
    got, want = {r["doc_id"] for r in kept.collect()}, set(label.tolist())
    missed, wrong = got - want, want - got
    assert not wrong and len(missed) <= 0.02 * len(texts)  # what the fingerprints may miss
    assert len({group[i] for i in order}) <= len(got)


def test_chains_and_crowds_lose_no_link(spark):
    from tidewatt.llm.components import connected_components
    from tidewatt.llm.nearcopies import missed_links, near_copy_links, nodes_of

    rng = np.random.default_rng(21)
    texts = ["", " ", "\t\n", "one two", "ONE  two", "one two three"]
    for _ in range(8):  # chains: a text is near the one before it, now and then not even that
        words = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        for _ in range(25):
            texts.append(" ".join(words))
            n = int(rng.choice([4, 5, 6, 8]))
            words = words[n:] + [f"w{x}" for x in rng.integers(0, 10**6, n)]
    base = [f"b{x}" for x in range(120)]
    for _ in range(150):  # a crowd: cut and edited copies on either side of the limit
        cut = int(rng.integers(0, 20))
        texts.append(edited(base[cut:] if rng.random() < 0.5 else base[: 120 - cut], rng.uniform(0.01, 0.06), rng))
    texts = list(dict.fromkeys(texts[i] for i in rng.permutation(len(texts))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = nodes_of(df, "doc_id", "text")
    want = brute_near_copies(texts).tolist()

    def groups(links):
        roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
        return [roots.get(i, i) for i in range(len(texts))]

    assert 50 < len(set(want)) < len(texts) - 150
    assert groups(near_copy_links(df, nodes, "text", 0.8)) == want
    none = spark.createDataFrame([], "a long, b long")
    for every, often in ((1, 2), (2, 20)):  # all shared shingles frequent, some of both
        assert groups(missed_links(df, nodes, none, "text", 0.8, every, often)) == want


def test_near_copies_of_odd_rows(spark):
    from tests.llm.test_operators import ODD
    from tidewatt.llm.nearcopies import without_near_copies

    same = "a row without an id"
    odd = [*ODD, (None, same, "b"), (None, "another nameless row", "b"), (9, None, "c"), (10, same, "c"), (11, "twice told", "d"), (11, "told in two ways", "e")]
    df = spark.createDataFrame(odd, "doc_id long, text string, source string")
    rows = [(r["doc_id"], r["text"]) for r in without_near_copies(df).collect()]
    assert sorted((r for r in rows if r[0] is not None and r[0] != 11), key=str) == sorted([(1, ODD[0][1]), (3, ""), (5, ODD[6][1]), (6, "one"), (7, ODD[8][1]), (10, same)], key=str)
    assert [t for i, t in rows if i is None] == ["another nameless row"] and sum(i == 11 for i, _ in rows) == 1
    assert without_near_copies(df.where("false")).count() == 0


def test_repeats_are_gone_and_the_rest_stays(stages):
    from tests.llm.test_operators import brute_repeats

    _, before, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    left = {r["doc_id"]: r["text"] for r in after.collect()}
    for (i, t), (n, gone, spans, _) in zip(rows, brute_repeats([t for _, t in rows], 200)):
        assert n - gone <= len(left[i].encode()) <= n - gone + 6 * spans
        assert spans or left[i] == t


def test_mix_takes_whole_documents_but_for_the_last_of_a_source(stages):
    _, before, after = stages[3]
    whole = {(r["doc_id"], r["text"]) for r in before.collect()}
    parts = [r for r in after.collect() if (r["doc_id"], r["text"]) not in whole]
    assert len(parts) <= 2 * before.select("source").distinct().count()


def test_every_document_of_the_mix_decodes(stages):
    _, before, after = stages[4]
    assert after.count() == before.count() and after.where("not round_trip").count() == 0
