"""Filter audit, conversation trie and language profiles against brute force, and their results for odd rows."""

import hashlib
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from tests.llm.test_operators import docs, nothing, rows_of  # noqa: F401  (fixtures)

SPACE = " \t\n\v\f\r"


# --- filter audit


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    first, good, toxic = {}, defaultdict(int), defaultdict(int)
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good[i], toxic[i] = max(good[i], q == 1), max(toxic[i], x == 1)
    masks = []
    for i, t, lang in rows:
        t = t or ""
        w = words_of(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": t in first and (i is None or i > first[t]),
        }
        masks.append((lang or "", fails, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out, shapley = [], defaultdict(int)
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [m for m in own if m[1][f] and not any(m[1][g] for g in order[: step - 1])]
                shapley[part, f] += len(gone)
                out.append({
                    "part": part, "filter_order": "".join(order), "step": step,
                    "kept": sum(not any(m[1][g] for g in order[:step]) for m in own), "removed": len(gone),
                    "redundant": sum(m[1][f] for m in own) - len(gone),
                    "unique_fails": sum(m[1][f] and sum(m[1].values()) == 1 for m in own),
                    "good_lost": sum(m[2] for m in gone), "toxic_lost": sum(m[3] for m in gone),
                })
    return [r | {"shapley": shapley[r["part"], r["filter_order"][r["step"] - 1]]} for r in out]


def by_step(rows):
    return sorted(rows, key=lambda r: (r["part"], r["filter_order"], r["step"]))


@pytest.mark.parametrize("shard_bytes", [1 << 24, 900])
def test_audit_equals_brute_force(spark, shard_bytes):
    from tidewatt.llm.audit import filter_audit

    rng = np.random.default_rng(4)
    made = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, (30, 400)[i % 2], int(rng.integers(0, 220)))]
        text = " ".join(words) + ("", " #", "\tX" * 60)[i % 3]
        made.append((i, text if i % 4 else (made[i // 8][1] if made else ""), (None, "", "en", "de")[int(rng.integers(0, 4))]))
    made += [(None, made[3][1], "en"), (None, "only here", "en"), (7, made[7][1], "de"), (500, None, None), (501, "", "de"), (502, "#" * 70_000, "x")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)] + [(4, 1, 0), (None, 1, 1), (9, None, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    df = spark.createDataFrame([(*r, "x", 1) for r in made], "doc_id long, text string, lang string, mask string, words int").repartition(5)
    got = filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), shard_bytes=shard_bytes)
    assert by_step(r.asDict() for r in got.collect()) == by_step(brute_audit(made, labels))


def test_matrix_holds_every_word_count_under_one_number_a_word(spark):
    from collections import Counter

    from tidewatt.llm import audit

    made = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i * 5)), "en") for i in range(40)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    shards = audit.split_shards(df, "doc_id", "text", "lang", 700)
    terms = audit.dictionary(shards)
    named = {r["code"]: bytes(r["word"]).decode() for r in terms.collect()}
    assert sorted(named) == list(range(len(named))) and shards.count() > 3
    seen = {}
    for r in audit.csr_shards(audit.term_matrix(shards, terms)).collect():
        for i, (a, b) in enumerate(zip(r["row_starts"], r["row_starts"][1:])):
            assert r["columns"][a:b] == sorted(r["columns"][a:b])
            seen[r["ids"][i]] = {named[c]: n for c, n in zip(r["columns"][a:b], r["counts"][a:b])}
    assert seen == {i: dict(Counter(t.split())) for i, t, _ in made}


def shard_of(pieces):
    """A shard that got each piece, rows (doc_id, part, text), in one call."""
    import pyarrow as pa

    from tidewatt.llm.audit import Shard

    shard = Shard()
    for rows in pieces:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
        shard.add(pa.record_batch(columns, ["id", "part", "text"]), 1)
    return shard


def test_shard_of_several_pieces_holds_the_words_of_every_text():
    from collections import Counter

    from tidewatt.llm.audit import NO_ID, unpacked

    texts = ["", "b a b", " \t\v", "\fa\x1cb a\x85 c\x00\u2028\n", "a " * 500 + "\u00e9", "", "z b\r", " "]
    rows = [(None if i == 3 else i, f"p{i % 2}", t) for i, t in enumerate(texts)]
    for pieces in ([rows], [rows[:1], rows[1:4], rows[4:]], [[r] for r in rows], [rows[:1]], [rows[2:3], rows[5:6]]):
        got = shard_of(pieces).row(5).to_pydict()
        flat = [r for p in pieces for r in p]
        assert got["shard"] == [5] and got["ids"] == [[NO_ID if r[0] is None else r[0] for r in flat]] and got["parts"] == [[r[1] for r in flat]]
        words, (sizes, steps, counts) = [bytes(w).decode() for w in got["words"][0]], (unpacked(got[c][0]) for c in ("ends", "codes", "counts"))
        assert len(set(words)) == len(words) and len(sizes) == len(flat)
        ends = np.cumsum(sizes)
        for (_, _, text), a, b in zip(flat, ends - sizes, ends):
            assert (steps[a + 1 : b] > 0).all()
            assert {words[c]: n for c, n in zip(np.cumsum(steps[a:b]), counts[a:b])} == dict(Counter(words_of(text)))


def test_python_work_of_a_shard_does_not_grow_with_the_words_of_its_texts():
    import cProfile
    import gc
    import pstats

    def calls(n):
        gc.collect()  # what other tests left is not to be counted
        profile = cProfile.Profile()
        rows = [(i, "en", " ".join(f"w{(i * j) % n}" for j in range(n))) for i in range(5)]
        gc.disable()
        try:
            profile.runcall(lambda: shard_of([rows]).row(0))
        finally:
            gc.enable()
        return pstats.Stats(profile).total_calls

    calls(10)  # imports
    assert calls(20_000) - calls(100) < 10_000


def test_audit_of_an_empty_table_has_no_row(spark):
    from tidewatt.llm.audit import filter_audit

    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- conversation trie


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, d == len(path)))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c, end in sorted(members) if end)
        out.append((min(members)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df, **kw):
    from tidewatt.llm.trie import prefix_trie

    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(df, **kw).collect()), key=str)


CHAT = "conv_id long, turn long, role string, text string, path string, shard int"


@pytest.mark.parametrize("shard_rows", [50_000, 4])
def test_trie_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(7)
    made = []
    for c in range(120):
        kind = int(rng.integers(0, 4))
        for t in range(int(rng.integers(1, 9))):
            text = "same" if kind == 0 else f"t{rng.integers(0, 2)}é" if kind < 3 else f"own {c}"
            made.append((c * (1 if c % 7 else 1000), t, ("user", "assistant")[t % 2], text, "x", 1))
    assert trie_rows(spark.createDataFrame(made, CHAT).repartition(4), shard_rows=shard_rows) == brute_trie([r[:4] for r in made])


def test_trie_of_odd_rows(spark):
    odd = [
        (1, None, "user", "first by null", "", 0), (1, 3, "user", "a", "", 0), (1, 3, "user", "a", "", 0), (1, 3, None, None, "", 0),
        (None, 1, "user", "no conversation", "", 0), (-7, 0, "user", "below zero", "", 0), (-10, 0, "a", "base", "", 0),
        (2, 0, "", "", "", 0), (3, 0, None, None, "", 0), *[(13, t, "user", f"long {t}", "", 0) for t in range(700)],
        (10, 1, "user", "x" * 100_000, "", 0), *[(c, 0, "user", "copy", "", 0) for c in range(100, 400)],
    ]
    df = spark.createDataFrame(odd, CHAT)
    assert trie_rows(df, shard_rows=9) == brute_trie([r[:4] for r in odd])
    assert trie_rows(df.where("false")) == []


# --- language profiles

SYLLABLES = {"aa": "ba lo mi ra su te", "bb": "sch ung ver ein kro", "cc": "eau ch qui ère mon", "dd": "ство при ный ова"}


def speech(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split(), int(rng.integers(1, 4)))) for _ in range(n))


def test_profiles_tell_held_out_languages_and_learn_only_from_the_rest(spark):
    from tidewatt.llm.langid import identify

    rng = np.random.default_rng(2)
    made = [(i, speech(lang := list(SYLLABLES)[i % 4], 5 + i % 60, rng), lang, lang) for i in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, score string")
    rows = rows_of(identify(df.repartition(3)))
    held = {i for i, *_ in made if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r["doc_id"] for r in rows if r["held_out"]} == held and len(held) > 50
    assert np.mean([r["lang_pred"] == made[r["doc_id"]][2] for r in rows if r["held_out"]]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    # Languages of held-out rows, sources and ids change no prediction.
    other = spark.createDataFrame([(i, t, "zz" if i in held else lang, "y") for i, t, lang, _ in made], df.schema)
    assert rows_of(identify(other)) == rows


def test_profiles_are_sums_of_bound_letters():
    from tidewatt.llm.langid import Profiles

    p = Profiles(64)
    roll = lambda c, k: np.roll(p.vector(ord(c)) if c else p.vector(0), k)
    want = sum(roll(a, 2) * roll(b, 1) * roll(c, 0) for a, b, c in [("", "a", "b"), ("a", "b", ""), ("b", "", "é"), ("", "é", "")])
    assert (p.of(["Ab, É!"])[0] == want).all()
    long = "abc é " * 60_000
    assert (p.of([long, "x"])[0] == p.of([long])[0]).all() and not p.of([""]).any()
    six, five = p.of(["abc é " * 6, "abc é " * 5])
    assert (p.of([long])[0] == six + (six - five) * 59_994).all()


def test_profiles_of_odd_rows(spark, docs, nothing):  # noqa: F811
    from tidewatt.llm.langid import identify, predict, prototypes

    with_lang = docs.selectExpr("*", "source as lang")
    rows = rows_of(identify(with_lang))
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["lang_pred"] == by_id[4]["lang_pred"] == "und" and by_id[4]["score"] == 0.0 and by_id[None]["held_out"]
    assert identify(nothing.selectExpr("*", "source as lang")).count() == 0
    untaught = predict(docs.selectExpr("*", "text as lang_pred"), {})
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"} and "d_lang_pred" in untaught.columns
    assert prototypes(with_lang.where("doc_id = 3")) == {}
    marks = spark.createDataFrame([(1, "́ 12", "a"), (2, "ñ", "a")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in rows_of(predict(marks, prototypes(marks)))] == ["und", "a"]
