"""Each operator against brute force on small tables, and its defined results for odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatt.llm.components import connected_components, local_components
from tidewatt.llm.queries import tokenizer_file

COPY = "the quick brown fox jumps over the lazy dog again and again until the sun goes down behind the far blue hills. "
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, COPY * 3, "a"),
    (2, COPY * 3, "b"),
    (2, COPY * 3, "b"),  # a row that repeats
    (3, "", "a"),
    (4, None, None),
    (None, "a row without an id", "a"),
    (5, LONG, "c"),
    (6, "one", "c"),
    (7, "\x1c odd\u2003space\n\n  <|endoftext|> ﬁ e\u0301 日本 '' don't\t", None),
    (8, "start " + COPY * 3 + "end", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, s, "x", 1.5, 7, "y", True) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fingerprint string, target double, size int, fp string, is_toxic boolean")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows_of(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0, str(r)))


def text(t):
    return t or ""


# --- mixing


def water_levels(sizes, share=1.5, cap=2.0):
    """Targets by dealing and dealing again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        dealt = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s: cap * sizes[s] for s in open_ if dealt[s] > cap * sizes[s]}
        if not above:
            return full | dealt
        full |= above


def test_mix_meets_targets_of_documents(spark):
    from tidewatt.llm.mixing import mix, mixed_documents

    made = [(i, " ".join("w" * (1 + i % 7) for _ in range(i * 37 % 400)), f"s{i % 7}" if i % 3 else "s0") for i in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    rows = rows_of(mixed_documents(mix(df, block_words=64)))
    sizes = Counter()
    for _, t, s in made:
        sizes[s] += len(t.split())
    targets = water_levels(sizes)
    source = {i: s for i, _, s in made}
    took = Counter()
    for r in rows:
        took[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]])
    assert all(took[s] == math.floor(targets[s] + 1e-9) for s in sizes)
    assert rows == rows_of(mixed_documents(mix(df, block_words=64)))


def test_slots_follow_their_weights_everywhere(spark):
    from tidewatt.llm.mixing import schedule

    plan = spark.createDataFrame([("sa", 60_000, 60_000, 60, 60, 1000), ("sb", 30_000, 30_000, 30, 30, 1000), ("sc", 10_000, 10_000, 10, 10, 1000)], "source_key string, source_size long, need long, blocks long, n long, block_words int")
    slots = rows_of(schedule(plan), "slot")
    first = [r for r in slots if r["slot"] < max(s["slot"] for s in slots) / 2]
    counts = Counter(r["source_key"] for r in first)
    assert sum(r["words"] for r in slots) == 100_000
    assert 0.35 < counts["sa"] / 60 < 0.7 and 0.3 < counts["sb"] / 30 < 0.7


def test_edges_of_ten_thousand_million_slots(spark):
    from tidewatt.llm.mixing import POINTS, edge

    total = 10**10 + 7
    cuts = [0, 1, total // 3, total - 1, total, 9 * 10**9]
    got = spark.createDataFrame([(c,) for c in cuts], "cum long").select("cum", edge(F.col("cum"), total).alias("at")).collect()
    assert {r["cum"]: r["at"] for r in got} == {c: c * POINTS // total for c in cuts}


def test_mix_of_odd_rows(docs, nothing):
    from tidewatt.llm.mixing import mix, mixed_documents, mixed_texts

    mixed = mix(docs)
    rows = rows_of(mixed_documents(mixed))
    assert len(rows) == len(ODD)
    assert {r["doc_id"]: r["taken"] for r in rows}[3] == 0
    assert mixed_documents(mix(nothing)).count() == 0
    texts = mixed_texts(docs, mixed)
    assert texts.columns == docs.columns and texts.count() >= len(ODD) - 1


# --- fingerprints


def test_fingerprints_estimate_the_generalised_jaccard(spark):
    from tidewatt.llm.weighted import fingerprints

    rng = np.random.default_rng(3)
    made = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 200) % 300)) for i in range(40)]
    made[11] = (11, made[10][1])
    rows = {r["doc_id"]: r for r in rows_of(fingerprints(spark.createDataFrame(made, "doc_id long, text string")))}
    texts, off = dict(made), []
    for i, t in texts.items():
        after = texts[i - 1 if i else 39]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        for other, got in ((edited, rows[i]["near_edited"]), (after, rows[i]["near_next"])):
            a, b = Counter(t.split()), Counter(other.split())
            off.append(got - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.03 and np.sqrt(np.mean(np.square(off))) < 0.1
    assert rows[10]["fingerprint"] == rows[11]["fingerprint"] and rows[11]["near_next"] == 1.0


def test_fingerprints_of_long_texts_estimate_the_generalised_jaccard(spark):
    from tidewatt.llm.weighted import fingerprints

    rng, n = np.random.default_rng(8), 12
    p = 1 / np.arange(1, 40_001)
    made = [(i, " ".join(f"w{x}" for x in rng.choice(40_000, 20_000, p=p / p.sum()))) for i in range(n)]
    off = []
    for r in fingerprints(spark.createDataFrame(made, "doc_id long, text string").repartition(n)).collect():
        t, after = made[r["doc_id"]][1], made[(r["doc_id"] - 1) % n][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        for other, got in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = Counter(t.split()), Counter(other.split())
            off.append(got - sum((a & b).values()) / sum((a | b).values()))
    assert len(off) == 2 * n and abs(np.mean(off)) < 0.05 and np.sqrt(np.mean(np.square(off))) < 0.1


def test_fingerprints_stay_in_the_jvm(docs):
    from tidewatt.llm.weighted import fingerprints

    plan = fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_of_odd_rows(docs, nothing):
    from tidewatt.llm.weighted import fingerprints

    rows = rows_of(fingerprints(docs))
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) and by_id[3]["fingerprint"] == by_id[4]["fingerprint"] and by_id[3]["near_edited"] == 1.0
    assert by_id[1]["near_next"] < 1 and by_id[2]["near_next"] == 1.0  # after 2 comes 1, after 1 the row without an id
    assert fingerprints(nothing).count() == 0


# --- toxicity


def test_chain_catches_marked_texts_and_leaves_clean_ones(spark):
    from tidewatt.llm.toxicity import fit_chain, score

    rng = np.random.default_rng(5)

    def made(start, n):
        out = []
        for i in range(start, start + n):
            words = [f"v{x}" for x in rng.integers(0, 900, 60)]
            toxic, low = i % 7 == 0, i % 5 == 0
            out.append((i, " ".join(words + ["rotten", "vile"][: 1 + i % 2] * toxic + ["buy"] * low), int(low), int(toxic)))
        return spark.createDataFrame(out, "doc_id long, text string, low int, toxic int")

    train, held = made(0, 1200), made(5000, 600)
    chain = fit_chain(train.select("doc_id", "text"), train, ("low", "toxic"))
    assert len(chain.links[1].earlier) == 1
    counts = score(held, chain).groupBy("toxic", "is_toxic").count().collect()
    table = {(r["toxic"], r["is_toxic"]): r["count"] for r in counts}
    assert table.get((1, False), 0) <= 2 and table.get((0, True), 0) <= 5


def test_toxicity_of_odd_rows(spark, docs, nothing):
    from tidewatt.llm.toxicity import fit_chain, score

    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    scored = score(docs, fit_chain(docs, labels, ("toxic",)))
    assert scored.count() == len(ODD) and "d_is_toxic" in scored.columns
    unlabelled = score(docs, fit_chain(docs, labels.where("false"), ("toxic",)))
    assert unlabelled.where("is_toxic").count() == 0
    assert score(nothing, fit_chain(nothing, labels, ("toxic",))).count() == 0


# --- records


def test_records_round_trip(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    from tidewatt.llm.records import read_sequences, records_digest, write_records

    path = tokenizer_file("byte_bpe_50k.json")
    written = write_records(docs, path, 2, folder=str(tmp_path / "set"), shards=3)
    rows = rows_of(records_digest(spark, written), "start")
    library, start = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(rows, sorted(((i, text(t)) for i, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0))):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    index = spark.read.parquet(written.index)
    back = read_sequences(spark, written, index.where("doc_id = 7")).collect()
    assert back[0]["ids"] == [*library.encode(ODD[8][1], add_special_tokens=False).ids, 2]
    empty = write_records(nothing, path, 2, folder=str(tmp_path / "none"))
    assert records_digest(spark, empty).count() == 0


def test_full_table_keeps_the_chunks_in_use(monkeypatch):
    from tokenizers import Tokenizer

    from tidewatt.llm import common
    from tidewatt.llm.records import Encoder

    path, learnt = tokenizer_file("byte_bpe_50k.json"), Counter()
    encode, library = Encoder(path), Tokenizer.from_file(path)
    learn = encode.known.learn
    monkeypatch.setattr(encode.known, "learn", lambda chunk: learnt.update([chunk]) or learn(chunk))
    monkeypatch.setattr(common, "CACHE_ENTRIES", 50)
    for i in range(40):
        t = f"often é, word{i}x " + " ".join(f"rare{chr(97 + j)}{chr(97 + i % 26)}{'z' * (i // 26)}" for j in range(20)) + " often"
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert learnt["often"] == learnt[" often"] == learnt[" é"] == learnt[","] == 1
    assert len(encode.known) + len(encode.known.before) < 200


def test_damaged_record_is_an_error():
    from tidewatt.llm.records import CLOSE, frame, frames

    data = bytearray(frame(5, np.array([1, 2, 70_000], "<u4")) + CLOSE)
    assert list(frames(bytes(data)))[0][3].tolist() == [1, 2, 70_000]
    data[20] ^= 1
    with pytest.raises(ValueError):
        list(frames(bytes(data)))


# --- simhash


def plain_fingerprint(t):
    import xxhash

    w = t.encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum((2 * c > len(grams)) << b for b, c in enumerate(counts)) if grams else 0


def test_simhash_fingerprint_is_the_plain_one():
    from tidewatt.llm.simhash import fingerprint

    for _, t, _ in ODD[:6] + ODD[7:]:
        assert fingerprint(text(t)) == plain_fingerprint(text(t))


@pytest.mark.parametrize("shuffles", ["3", "8"])
def test_gray_index_links_what_brute_force_links(spark, shuffles):
    from tidewatt.llm.simhash import link_stars

    rng, before = np.random.default_rng(1), spark.conf.get("spark.sql.shuffle.partitions")
    base = rng.integers(0, 1 << 63, 150, dtype="u8")
    fp = list(base)
    for i, (b, far) in enumerate([(b, f) for b in base[:60] for f in (1, 2, 3, 4, 6)] + [(base[0], 2)] * 300):
        for k in rng.choice(64, far, replace=False):
            b = b ^ np.uint64(1 << int(k))
        fp.append(b)
    fp = np.unique(np.array(fp, "u8"))
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    stars = link_stars(spark.createDataFrame([(int(x),) for x in fp.view("i8")], "fp long")).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    at = {int(v): k for k, v in enumerate(fp.view("i8"))}
    got = local_components(len(fp), np.array([at[x] for x in stars.a]), np.array([at[x] for x in stars.b]))
    assert np.array_equal(got, local_components(len(fp), i, j))


def test_simhash_of_odd_rows(docs, nothing):
    from tidewatt.llm.simhash import near_duplicates

    rows = rows_of(near_duplicates(docs))
    got = [(r["doc_id"], r["component_id"]) for r in rows]
    assert (1, 1) in got and got.count((2, 1)) == 2 and (4, 3) in got and (None, None) in got and len(rows) == len(ODD)
    assert next(r for r in rows if r["doc_id"] == 4)["fingerprint"] == "0" * 16
    assert near_duplicates(nothing).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


# --- urls


def test_rules_and_templates(spark, nothing):
    from tidewatt.llm.urls import Rule, judge_urls

    rules = (Rule("block", "bad.org", "/ads/"), Rule("allow", "org", "/ads/fine/"))
    made = [(i, f"http://Shop.bad.org/ads/{i}.html?x=/") for i in range(40)] + [(100 + i, f"http://shop.bad.org/news/{i}#a") for i in range(40)]
    made += [(200, "http://bad.org/ads/fine/1"), (201, None), (202, "no scheme"), (203, "x://HOST"), (204, "http://notbad.org/ads/1"), (200, "http://bad.org/ads/fine/1")]
    df = spark.createDataFrame(made, "page_id long, url string").selectExpr("*", "'z' as host", "1 as n")
    rows = rows_of(judge_urls(df, rules), "page_id")
    by_id = {r["page_id"]: r for r in rows}
    assert len(rows) == len(made)
    assert (by_id[3]["host"], by_id[3]["path"], by_id[3]["rule"], by_id[3]["verdict"], by_id[3]["template"]) == ("shop.bad.org", "/ads/3.html", "bad.org/ads/", "block", "/ads/{num}")
    assert by_id[103]["rule"] is None and by_id[103]["verdict"] == "allow" and by_id[103]["template"] == "/news/{num}"
    assert by_id[200]["verdict"] == "allow" or by_id[200]["rule"] == "bad.org/ads/"
    assert (by_id[201]["host"], by_id[201]["path"], by_id[202]["host"], by_id[203]["host"], by_id[203]["path"]) == ("", "", "", "host", "")
    assert by_id[204]["rule"] is None
    assert judge_urls(df.where("false"), rules).count() == 0


def test_bad_templates_are_rejected(spark):
    from tidewatt.llm.urls import Rule, judge_urls

    made = [(i, f"http://h.com/spam/{i}/{'go' if i % 4 else 'stay'}") for i in range(80)] + [(900 + i, f"http://h.com/good/{i}/go") for i in range(80)]
    rules = tuple(Rule("block", "h.com", f"/spam/{i}/") for i in range(0, 80) if i % 8)
    rows = {r["page_id"]: r for r in rows_of(judge_urls(spark.createDataFrame(made, "page_id long, url string"), rules), "page_id")}
    assert rows[8]["rule"] is None and rows[8]["verdict"] == "block" and rows[905]["verdict"] == "allow"


# --- unigram


def brute_viterbi(pieces, marked, fallback):
    score = {t: s for t, s in zip(pieces.texts, pieces.scores) if t}
    best = [0.0] + [-math.inf] * len(marked)
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - 16), j):
            if marked[i:j] in score:
                best[j] = max(best[j], best[i] + score[marked[i:j]])
        if marked[j - 1 : j] not in score:
            best[j] = max(best[j], best[j - 1] + fallback)
    return best[-1]


def test_unigram_paths_are_the_best_and_decode(spark, docs, nothing):
    from tidewatt.llm import unigram

    pieces = unigram.load_pieces(tokenizer_file("piece_bpe_32k.model"))
    codec = unigram.Codec(pieces, unigram.build_trie(pieces))
    fallback = codec.viterbi.fallback
    for t in ("Hello there, générale", "日本 x\n\ttwo  spaces ", "thntblere of then"):
        (ids,) = codec.encode([t])
        marked, chars, byte_run = unigram.MARKER + t.replace(" ", unigram.MARKER), 0, set(pieces.byte_ids)
        covered = {x for x in pieces.texts if len(x) == 1}
        lost = sum(c not in covered for c in marked)
        got = sum(pieces.scores[i] for i in ids if i not in byte_run) + lost * fallback
        assert got == pytest.approx(brute_viterbi(pieces, marked, fallback))
        assert codec.decode(ids.tolist()) == t
    rows = rows_of(unigram.encode(docs, pieces, keep=["source"]))
    assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
    back = {r["doc_id"]: r["text"] for r in rows_of(unigram.decode(unigram.encode(docs, pieces), pieces))}
    assert all(back[i] == text(t) for i, t, _ in ODD)
    assert unigram.encode(nothing, pieces).count() == 0


def test_a_unigram_model_keeps_its_scores(tmp_path):
    from sentencepiece import SentencePieceProcessor, SentencePieceTrainer

    from tidewatt.llm import unigram

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeirstn"), rng.integers(2, 9))) for _ in range(300)]
    lines = [" ".join(rng.choice(words, 12)) for _ in range(400)]
    SentencePieceTrainer.train(sentence_iterator=iter(lines), model_prefix=str(tmp_path / "small"), model_type="unigram", vocab_size=420, byte_fallback=True, normalization_rule_name="identity", remove_extra_whitespaces=False, minloglevel=2)
    sp = SentencePieceProcessor(model_file=str(tmp_path / "small.model"))
    pieces = unigram.load_pieces(str(tmp_path / "small.model"))
    codec = unigram.Codec(pieces, unigram.build_trie(pieces))
    assert all(pieces.scores[i] == sp.get_score(i) for i, t in enumerate(pieces.texts) if t)
    for line in lines[:40]:
        (ids,) = codec.encode([line])
        theirs = sp.encode(line)
        assert sum(pieces.scores[i] for i in ids) == pytest.approx(sum(sp.get_score(i) for i in theirs), rel=1e-5)


# --- token counts


def test_prefix_counts_are_the_library_s(spark, docs, nothing):
    from tokenizers import Tokenizer

    from tidewatt.llm.tokencount import PrefixCounter, at_prefix, fit_to_budget, prefix_counts

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    many = lambda texts: [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = PrefixCounter(path)
    for t in ("Don't STOP; 42 times?\n\n  x.y&&& naïve Straße <|endoftext|> end", "a" * 60 + " b", COPY):
        steps, n = counter(t)
        assert at_prefix(steps, len(t)).tolist() == many([t[:i] for i in range(len(t) + 1)]) and n == many([t])[0]
    counts = prefix_counts(docs, path)
    rows = rows_of(counts)
    want = {i: many([text(t)])[0] for i, t, _ in ODD}
    assert len(rows) == len(ODD) and all(r["n_tokens"] == want[r["doc_id"]] and r["n_bytes"] == len(text(dict((i, t) for i, t, _ in ODD)[r["doc_id"]]).encode()) for r in rows)
    fits = {r["doc_id"]: r["fits"] for r in fit_to_budget(counts, 5).collect()}
    assert many([ODD[0][1][: fits[1]]])[0] <= 5 < many([ODD[0][1][: fits[1] + 1]])[0] and fits[3] == 0
    assert prefix_counts(nothing, path).count() == 0


def test_counts_of_every_letter_beside_every_mark():
    from tokenizers import Tokenizer

    from tidewatt.llm.tokencount import PrefixCounter, at_prefix

    path = tokenizer_file("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), PrefixCounter(path)
    many = lambda texts: [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    letters = [chr(x) for x in range(0x41, 0x250) if chr(x).isalpha()]
    marks = [chr(x) for x in range(33, 127) if not chr(x).isalnum()]
    texts = [t for a in letters for m in marks for t in (f"{a}{m} x{a}", f"{m}{a}{m}{m}b{a} {m}")]
    assert [counter(t)[1] for t in texts] == many(texts)
    rng = np.random.default_rng(12)
    pool = [*letters, *marks * 3, *" " * 60, *"\n\t\x1c\x1f\x85", "'s", "'ll", "9", "\u0301", "\u0307", "<|endoftext|>", "\uac00"]
    for text in ("".join(rng.choice(pool, int(rng.integers(1, 24)))) for _ in range(3000)):
        steps, n = counter(text)
        want = many([text[:i] for i in range(len(text) + 1)]) if "\x1c" in text or n % 4 == 0 else None
        assert n == (want or many([text]))[-1] and (want is None or at_prefix(steps, len(text)).tolist() == want)


def test_prefix_counts_inside_long_runs():
    from tokenizers import Tokenizer

    from tidewatt.llm.tokencount import PrefixCounter, at_prefix

    path = tokenizer_file("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), PrefixCounter(path)
    rng = np.random.default_rng(2)
    drawn = lambda letters, n: "".join(rng.choice(list(letters), n))
    runs = [
        "".join(drawn("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", 600)),
        "the" * 30 + drawn("aeinorst", 600),
        "a" * 600,
        drawn("\u6587\u5b57\u5217\u7684\u4e00\u662f\u6709", 600),
        "9" + "".join(rng.choice(["'ll", "'l", "x", "&&", "e\u0323\u0301", "\u0130", "<|endoftext|>", "<|endof", "9", "\u1112\u1161\u11ab"], 300)),
        "=-" * 300 + "it's",
    ]
    for run in runs:
        t = "so " + run + " end"
        steps, n = counter(t)
        want = [len(e.ids) for e in library.encode_batch([t[:i] for i in range(len(t) + 1)], add_special_tokens=False)]
        assert len(run) >= 600 and at_prefix(steps, len(t)).tolist() == want and n == want[-1]
    steps, n = counter("a1" * 20_000)
    assert n == 40_000 and np.array_equal(at_prefix(steps, 40_000), np.arange(40_001))


def test_a_step_may_be_wider_than_two_bytes(monkeypatch):
    from tidewatt.llm.tokencount import PrefixCounter, at_prefix

    counter = PrefixCounter(tokenizer_file("word_bpe_49k.json"))
    monkeypatch.setattr(counter, "_counts", lambda word: [40_000 * len(word)] * len(word))
    steps, n = counter("ab cd")
    assert n == 160_000 and at_prefix(steps, 5).tolist() == [0, 80_000, 80_000, 80_000, 160_000, 160_000]


# --- vectors


def test_vector_links_equal_brute_force(spark):
    from tidewatt.llm.vectors import near_duplicates

    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 24))
    v = np.concatenate([base, base[:60] + rng.normal(size=(60, 24)) * 0.12, np.repeat(base[:3], 5, axis=0), base[5] + rng.normal(size=(80, 24)) * 0.1, base[7:8] * 3])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = local_components(len(u), *np.nonzero(hit))
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [1.0, None] + [0.0] * 22), (1004, [float("nan")] * 24)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as pid", "'x' as bytes")
    rows = rows_of(near_duplicates(df), "vec_id")
    assert [r["n_links"] for r in rows[: len(u)]] == hit.sum(axis=1).tolist()
    assert [r["component_id"] for r in rows[: len(u)]] == want.tolist()
    assert all(r["n_links"] == 0 and r["kept"] for r in rows[len(u) :])
    assert near_duplicates(df.where("false")).count() == 0


def test_graph_search_meets_what_is_near():
    from tidewatt.llm.vectors import prune, search, unit

    rng = np.random.default_rng(4)
    x = unit(np.concatenate([rng.normal(size=(400, 16)), np.repeat(rng.normal(size=(1, 16)), 100, axis=0) + rng.normal(size=(100, 16)) * 0.05]))
    *lists, (medoid,) = prune(x)
    got = {p for r, m in search(x, lists, int(medoid), x, 0.9) for p in zip(r.tolist(), m.tolist())}
    want = set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.9))))
    assert len(got & want) >= 0.97 * len(want) and got <= want


# --- repeats


def brute_repeats(texts, length):
    raw = [t.encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, "u1")[~gone])).hexdigest()))
    return out


def repetitive(n=60):
    rng = np.random.default_rng(8)
    noise = lambda k: " ".join(f"n{x}é" for x in rng.integers(0, 10**6, k))
    shared = [noise(k) for k in (30, 45, 60)]
    out = []
    for i in range(n):
        s = shared[i % 3]
        out.append(noise(10 + i % 9) + s[i % 5 : len(s) - i % 7] + noise(5) + (s if i % 11 == 0 else ""))
    return [*out, "x" * 700, "ab" * 300 + noise(3), shared[2][:199], shared[2][:200], ""]


@pytest.mark.parametrize("crowd", [1000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    from tidewatt.llm import repeats

    monkeypatch.setattr(repeats, "CROWD", crowd)
    texts = repetitive()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rows_of(repeats.without_repeats(df))
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute_repeats(texts, 200)


def test_repeats_of_odd_rows(docs, nothing):
    from tidewatt.llm import repeats

    rows = rows_of(repeats.without_repeats(docs))
    want = dict(zip([i for i, _, _ in ODD], brute_repeats([text(t) for _, t, _ in ODD], 200)))
    assert len(rows) == len(ODD)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in rows)
    cut = repeats.texts_without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ODD) and cut.where("doc_id = 4 and text is null").count() == 1
    assert repeats.without_repeats(nothing).count() == 0
