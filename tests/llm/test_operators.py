"""The training-data operators against brute force, round trips and planted cases."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstat.llm import bpe, components, exact_dedup, language, near_dedup, packing, pii, quality, queries, sharding, topk, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, id string, n long, _text string, score string"
LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [
    None, "", "   \n", "Hello", "one two three four", "One two three FOUR", LONG, LONG + " tail", "a b c d e f g h", "a b c d e f g h",
    "x" * 20_000, "mail me at jo.x@mail.example.com or +1 (238) 555-6608, 10.0.0.1", "card 4111 1111 1111 1111 and 1234567890123456",
    "naïve Σίσυφος 漢字 🙂 <|endoftext|> it's 42!", "IBAN DE89 3704 0044 0532 0130 00 ok", "1.2.3.4.5.6.7.8 999.1.1.1 a@b.c_d@e.f..g@h.i",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Every awkward text once, an id twice, a null id, and extra columns with the operators' own names."""
    rows = [(i, t, "x", 1, "y", "z") for i, t in enumerate(TEXTS)]
    rows += [(3, "Hello", "x", 1, "y", "z"), (None, "Hello", "x", 1, "y", "z")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def jaccard_components(texts, percent=75):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    best = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and best[i] != best[j]:
                    best[i] = best[j] = min(best[i], best[j])
                    changed = True
    return [len(s) for s in sets], best


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in rng.integers(0, 500, 120)]
    texts = list(TEXTS)
    for _ in range(40):  # copies of one text with more and more changes
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 9)):
            words[at] = f"n{rng.integers(0, 10_000)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(rows).orderBy("doc_id").collect()
    sizes, best = jaccard_components(texts)
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == best
    assert [r.kept for r in got] == [i == b for i, b in enumerate(best)]


def test_near_duplicates_awkward_rows(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in got if r.doc_id == 3} == {3}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    m1, a = near_dedup.odd_sketch(items[:900])
    m2, b = near_dedup.odd_sketch(items[100:])
    z = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
    d = -near_dedup.BITS / 2 * np.log(1 - 2 * z / near_dedup.BITS)
    union = near_dedup.BINS * (1 - np.exp(-1000 / near_dedup.BINS))
    assert abs((m1 + m2 - d) / 2 / union - 0.8) < 0.05


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.components(edges.unionByName(spark.createDataFrame([(900, 901), (7, 7)], "u long, v long")))
    found = {r.node: r.component for r in got.collect()}
    assert found == {i: 0 for i in range(301)} | {900: 900, 901: 900}
    assert components.components(edges.limit(0)).count() == 0


def test_bpe_equals_library_and_decodes(docs, empty):
    library = Tokenizer.from_file(PATH)
    rows = bpe.encode_and_decode(docs.withColumn("ids", F.lit("clash")), PATH).collect()
    want = {t: library.encode(t or "", add_special_tokens=False).ids for t in TEXTS}
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids = want[TEXTS[r.doc_id] if r.doc_id is not None else "Hello"]
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_and_decode(empty, PATH).count() == 0
    again = bpe.decode(bpe.encode(docs, PATH), PATH).select("ids", "decoded").collect()
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in again)


def test_bpe_random_texts():
    coder, library = bpe.WordBPE(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    letters = list("aAbeElLsStTdDmMvVrR'' 019!?<|>\n\tΣσÉéß\x1c\x85\xa0漢🙂İ́")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)] + ["ab" * 4000, "a" * 5000]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert coder.encode(t).tolist() == e.ids


def test_merges_go_leftmost_lowest_rank_first():
    ranks = {(1, 1): (0 << 32, 2), (2, 2): (1 << 32, 3), (2, 1): (2 << 32, 4)}
    assert bpe.merge_word([1] * 7, ranks) == [3, 4]
    assert bpe.merge_word([1], ranks) == [1] and bpe.merge_word([], ranks) == []


def test_language(spark, empty, docs):
    rng = np.random.default_rng(2)
    parts = {"aa": ["th", "er", "ing"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "ou", "é"]}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(rng.integers(5, 60))), lang))
    rows += [(900, None, "aa"), (901, "th", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r for r in language.predict(table, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[:300] if i % 2]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].lang_pred == "und"
    assert 0 < (model.weights != 0).mean() < 0.2
    nothing = language.train(empty.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, nothing).collect()} == {("und", 0.0)}
    blank = language.predict(docs, model).where(F.col("doc_id").isin(0, 1, 2)).collect()
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)}


def test_language_sample_reaches_every_language(spark, monkeypatch):
    assert language.quota([1_000_000] * 4, 600) == 600 and language.quota([1000] * 40 + [1] * 500, 600) == 487
    assert language.quota([1000] * 5000, 600) == language.FEW
    monkeypatch.setattr(language, "MAX_SAMPLE", 120)
    # Ordered by language, as a corpus put together from sources is; the last language has one row.
    rows = [(i, f"w{chr(97 + i // 40) * 3} " * 6, f"l{i // 40:02}") for i in range(480)] + [(999, "zyx zyx", "rare")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), F.lit(True))
    assert model.languages == [*(f"l{k:02}" for k in range(12)), "rare"]


def test_language_learns_rare_languages(spark):
    rows = [(i, f"text number {i}", f"l{i}") for i in range(1003)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), epochs=0)
    assert len(model.languages) == 1003


def test_exact_duplicates(docs, empty, spark):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 2
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    assert set(groups) == {hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS}
    for members in groups.values():
        assert sum(r.kept for r in members) == 1
        ids = [r.doc_id for r in members if r.doc_id is not None]
        assert {(r.keep_id, r.group_size) for r in members} == {(max(ids), len(members))}
    assert exact_dedup.exact_duplicates(empty).count() == 0
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("same").alias("text"))
    assert exact_dedup.exact_duplicates(hot).where("kept").count() == 5000 - 1667 + 1


def test_quality_rules_and_expression(spark, docs, empty):
    rng = np.random.default_rng(4)
    good = [" ".join(f"wo{i}rd" for i in rng.integers(0, 500, 60)) + "." for _ in range(150)]
    bad = [" ".join(["LOUD!!"] * 40 + [f"W{i}!!" for i in rng.integers(0, 50, 20)]) for _ in range(75)] + ["same " * 60] * 75
    rows = [(i, t) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(table, labels, F.col("doc_id") % 3 > 0)
    assert 0 < len(model.rules) < 200
    got = {r.doc_id: r.predicted for r in quality.score(table, model).collect()}
    assert np.mean([got[i] == int(i < 150) for i in range(0, 300, 3)]) > 0.97
    assert quality.score(docs, model).count() == len(TEXTS) + 2
    assert {r.predicted is not None and 0 <= r.score <= 1 for r in quality.score(docs, model).collect()} == {True}
    nothing = quality.train(empty, labels.limit(0), F.lit(True))
    assert quality.score(docs, nothing).where("score = 0.5").count() == len(TEXTS) + 2


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (40, 2))]
        bad = i % 6 == 0
        if bad:
            words[3] = ["nastyword", "vilest", "vilely"][i % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(table, known, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.predicted for r in toxicity.score(table, model).collect()}
    assert all(got[i] == y for i, y in labels if i % 4 == 2)
    assert toxicity.score(docs, model).count() == len(TEXTS) + 2
    assert toxicity.score(docs, toxicity.train(empty, known.limit(0), F.lit(True))).where("score < 1e-9 and predicted = 0").count() == len(TEXTS) + 2


def test_packing_coder_equals_library():
    coder, library = packing.LibraryCoder(PATH), Tokenizer.from_file(PATH)
    rng, pool = random.Random(11), [chr(c) for c in range(0x300, 0x370)] + list("İÀΣςŉ'sSt<|endoftext|> \t中😀")
    texts = ["", "İ\u0356", "a's", *("".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(500))]
    for text in texts:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_packing_coder_stays_small():
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}q{k:x}" for k in range(450_000)]
    tracemalloc.start()
    coder = packing.LibraryCoder(PATH)
    coder.runs.encode = lambda run: run.encode() + b"...."
    for k in range(0, len(words), 1000):
        coder.encode(" ".join(words[k : k + 1000]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(coder.runs) + len(coder.runs.old) <= 2 * packing.RUNS
    assert held < 75e6


def test_packing(docs, empty):
    library = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, capacity=512, with_ids=True).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in enumerate(TEXTS):
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        if i == 3:
            continue  # this id is there twice
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in pieces for x in r.ids] == want
        assert [r.start for r in pieces] == list(range(0, len(want), 512))
    for rows in by_bin.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(by_bin) == -(-sum(r.length for r in got) // 512)
    assert packing.pack(empty, PATH).count() == 0


def test_bins_are_filled_best():
    assert packing.fullest({7: 3, 5: 1, 2: 1}, 16) == [(7, 2), (2, 1)]
    rng = np.random.default_rng(9)
    counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 150), 60, replace=False), rng.integers(1, 500, 60))}
    bins = packing.plan_bins(counts, 400)
    used = {}
    for combination, times in bins:
        assert sum(k * c for k, c in combination) <= 400
        for k, c in combination:
            used[k] = used.get(k, 0) + c * times
    assert used == counts
    assert sum(t for _, t in bins) <= -(-sum(k * n for k, n in counts.items()) // 400) + 1


def test_sharding(docs, empty, spark):
    got = sharding.shuffle_into_shards(docs.repartition(5), 4).collect()
    sizes = sorted(sum(r.shard == s for r in got) for s in range(4))
    assert sizes == [4, 4, 5, 5]
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "Hello") or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)
    assert sharding.shuffle_into_shards(empty).count() == 0
    many = spark.range(4000).repartition(7).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    placed = sharding.shuffle_into_shards(many).toPandas()
    assert abs(np.corrcoef(placed.doc_id, placed.shard * 500 + placed.slot)[0, 1]) < 0.08


def test_matrix_has_exact_sums():
    m = sharding.communication_matrix([10, 0, 7, 3_000_000_000], [1_000_000_006, 1_000_000_006, 1_000_000_005], 3)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 3_000_000_000] and m.sum(axis=0).tolist() == [1_000_000_006, 1_000_000_006, 1_000_000_005]


@pytest.mark.parametrize("blocks", [(8_192, 2_048), (37, 5)])
def test_top_k_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", blocks[0])
    monkeypatch.setattr(topk, "QUERY_ROWS", blocks[1])
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=40).tolist() for _ in range(500)]
    vectors[30:60] = [vectors[30]] * 30  # ties
    rows = [(i, v, i) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1020, [1.0, None] + [0.0] * 38, 0), (1040, [float("nan")] * 40, 0), (1060, [float("inf")] * 40, 0), (None, vectors[0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = np.floor(64 * np.array(vectors)).astype(np.int64)
    assert set(got) == set(range(0, 500, 20))
    for q in got:
        scores = whole @ whole[q]
        order = sorted((i for i in range(500) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert [got[q][k] for k in range(1, 21)] == [(i, scores[i]) for i in order]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(table.where("vec_id < 8"), F.col("vec_id") % 4 == 0, k=20).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(q, k) for q in (0, 4) for k in range(1, 8)]


def test_blocks_that_cannot_reach_a_floor_are_left_out(spark, monkeypatch):
    """Long rows all lie in one block by themselves here: the short rows of other blocks need not be searched, and repeated ids each count."""
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 10)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * (1000 if i < 120 else 0.01)).tolist()) for i in range(400)] + [(7, [900.0, 1.0, 2.0, 3.0])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows]
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 50):
        want = sorted((-int(v @ whole[q][1]), i) for i, v in whole if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]


def brute_pii(text):
    out = []
    for order, (kind, pattern) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit() and c.isascii()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                odd = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or odd % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_pii_matches_brute_force(spark, docs, empty):
    rng = np.random.default_rng(10)
    pieces = ["a@b.c", "_d@e.f", "x.y@", "@z.com", "..", "10.0.0.1", "256.1.1.1", ".5", "4111111111111111", " ", "-", "+1 ", "(238) 555-6608", "漢🙂", "12", "4111-1111 ", "x", ".", "00001.2.3.4"]
    texts = [*TEXTS, *("".join(rng.choice(pieces, rng.integers(1, 30))) for _ in range(600)), "1" * 30_000, "a" * 60_000, "a.b@c." * 500 + "de"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    for r in pii.find_pii(rows).collect():
        base = ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.pii if s.order < 4)
        assert base == brute_pii(texts[r.doc_id] or ""), texts[r.doc_id]
    iban = pii.find_pii(docs.where("doc_id = 14")).first().pii
    assert [(s.kind, s.score) for s in iban] == [("iban", 1.0)]
    assert pii.find_pii(empty).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(pii.find_pii(docs)).collect()}
    assert clean[14] == "IBAN <IBAN> ok" and clean[0] is None and clean[11] == "mail me at <EMAIL> or <PHONE>, <IP>"


def test_pii_query_returns_scores(spark, tmp_path):
    texts = ["call a@b.org now", "email: a@b.org", "nothing", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    assert all(len(r.scores) == len([s for s in r.spans.split(",") if s]) for r in got.values())
    assert got[0].scores and got[1].scores[0] > got[0].scores[0] and got[2].scores == [] == got[3].scores


def test_words_known_as_runs_are_not_merged_again():
    """A run of several words takes its words from the memory of runs; the library merges each word once."""
    coder, asked = packing.LibraryCoder(PATH), []

    class Counting:
        model = coder.library

        def tokenize(self, word):
            asked.append(word)
            return self.model.tokenize(word)

    coder.library = Counting()
    texts = ["river, bank. It's", "river bank; (river) bank! it's river,bank", "élan, élan. naïve-élan 12 2", "'s 's, 't''s \x1c river\x1cbank"]
    library = Tokenizer.from_file(PATH)
    assert [coder.encode(t).tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count("river") == asked.count("bank") == 1 and len(asked) == len(set(asked))
