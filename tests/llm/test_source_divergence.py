"""The source divergence audit against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomstat.llm import source_divergence as S

SCHEMA = "doc_id long, lang string, source string, text string, Text string, part string, value string, block int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, least, top):
    rows = [(a or "", b or "", c or "") for a, b, c in rows]
    df, counts = Counter(), Counter()
    for lang, source, text in rows:
        df.update((lang, t) for t in set(terms(text)))
        counts.update((lang, source, t) for t in terms(text))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    groups = defaultdict(list)
    for lang, source in sorted({(a, b) for a, b, _ in rows}):
        groups[lang].append(source)
    out = set()
    for lang, sources in groups.items():
        v = len(kept[lang])

        def shares(who):
            n = {t: sum(counts[lang, s, t] for s in who) for t in kept[lang]}
            total = sum(n.values())
            return n, {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * v) for t in kept[lang]}

        _, q = shares(sources)
        of = {s: shares([s]) for s in sources}
        for s in sources:
            n, p = of[s]
            pair = [(o, sum(abs(p[t] - of[o][1][t]) for t in kept[lang])) for o in sources if o != s]
            term = [(t, p[t] - q[t]) for t in kept[lang] if n[t] > 0 and p[t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out.update((lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1))
    return out


def documents(seed, n=160):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "naïve", "été", "漢字", "x1y", "don't", "Ω", "a_b", "-", "7", "Éa"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["hot"] * 4 + ["b", "c", None, "ä"])
        rows.append((lang, source, " ".join(rng.choices(words[: rng.randint(3, len(words))], k=rng.randint(0, 40)))))
    rows += [("de", "only", "eins zwei"), ("it", "a", ""), ("it", "b", None), ("en", "long", "alpha beta " * 20_000), ("en", "silent", " \n\t 123 ")]
    return rows + rows[:5]


def ask(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, "other", "p", "v", 1) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = [tuple(r) for r in S.source_divergence(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, least, top, cells", [(1, 5, 3, 50), (2, 30, 50, 400_000)])
def test_against_plain_python(spark, seed, least, top, cells):
    rows = documents(seed)
    assert ask(spark, rows, least=least, top=top, cells=cells) == plain(rows, least, top)


def test_blocks_of_sources_and_buckets_of_terms(spark, monkeypatch):
    monkeypatch.setattr(S, "SOURCES", 2)
    monkeypatch.setattr(S, "TERMS", 5)
    rows = documents(3)
    assert ask(spark, rows, least=4, top=4) == plain(rows, 4, 4)


def test_empty_table_and_types(spark):
    empty = S.source_divergence(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    assert dict(empty.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_terms_of_every_ascii_character_and_of_long_texts():
    text = "".join(map(chr, range(256))) + " " + "Ab" * 700_000 + "\x1c" + "cd " * 600_000
    found = Counter()
    for words in S.pieces(text.encode(), 1_000):
        found.update(words)
    assert found == Counter(t.encode() for t in terms(text))


def test_spilled_stripes_merge_to_the_same_stripe():
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.choice("pqr"), " ".join(rng.choices("abcdefgh", k=9)).encode()) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "source", "text"])
    merged = []
    lists = [pa.list_(pa.field("element", t, nullable=False)) for t in (pa.string(), pa.int64())]  # as Spark names them
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("sources", lists[0]), ("counts", lists[1])])
    for cells in (10, 10**6):
        spilled = [r for b in S.fold(cells)(iter([batch])) for r in b.to_pylist()]
        spilled.sort(key=lambda r: (r["lang"], r["term"]))
        again = pa.RecordBatch.from_pylist(spilled, schema=schema)
        merged.append({(r["lang"], r["term"]): (r["df"], dict(zip(r["sources"], r["counts"]))) for b in S.merge(40)(iter([again.slice(0, 7), again.slice(7)])) for r in b.to_pylist()})
    assert merged[0] == merged[1] and merged[0]
    assert all(df >= 40 for df, _ in merged[0].values())


def test_billionths_are_exact_for_large_counts():
    for count, total, v in itertools.product([0, 1, 10**9, 7 * 10**14], [7 * 10**14, 9 * 10**14 + 7], [1, 12_345]):
        got = S.billionths(np.array([count]), np.array([total]), np.array([v]))
        assert int(got[0]) == 1 + 10**9 * (count + 5) // (total + 5 * v)
