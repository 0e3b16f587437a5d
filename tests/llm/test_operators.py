"""Each operator against plain Python on a corpus with nulls, copies, ties and long texts."""

import collections
import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import langid, licences, mixing, packing, pii, quality, sharding, simhash, suffix, topk
from orrery.llm.queries import tokenizer

from .conftest import SCHEMA, make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_key(rows, key="doc_id"):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("text, added", [
    ("mail john (at) example (dot) com now", [("email", "john (at) example (dot) com")]),
    ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
    ("call plus one five five five one two three four five six seven ok", [("phone", "plus one five five five one two three four five six seven")]),
    ("x john at example dot com y", [("email", "john at example dot com")]),
    ("one nine two dot one six eight dot one dot one", [("ip", "one nine two dot one six eight dot one dot one")]),
    ("meet at the point of no return. six of one", []),
])
def test_pii_disguises(text, added):
    base, more = pii.find(text)
    assert not any(base.values())
    assert [(k, text[a:b]) for k in pii.KINDS for a, b in more[k]] == added


@pytest.mark.parametrize("text, added", [
    ("ring +44 seven seven zero 0900 123 now", [("phone", "+44 seven seven zero 0900 123")]),
    ("card 4111 1111 1111 1 one one one.", [("card", "4111 1111 1111 1 one one one")]),
    ("card 411111111111111 one.", [("card", "411111111111111 one")]),
    ("call plus one (five five five) one two three four five six seven ok", [("phone", "plus one (five five five) one two three four five six seven")]),
    ("plus one five five five one two\nthree four five six seven", [("phone", "plus one five five five one two\nthree four five six seven")]),
    ("host 192 dot 168 dot one dot 1 up", [("ip", "192 dot 168 dot one dot 1")]),
    ("write john at example dot it, or not", [("email", "john at example dot it")]),
    ("write john at example.ai", [("email", "john at example.ai")]),
    ("write john dot m dot doe at example dot com", [("email", "john dot m dot doe at example dot com")]),
    ("stare at the dot in the middle", []),
    ("one 2 three, two of 3, seven or eight; 1. one\n2. two\n3. three\n4. four", []),
])
def test_pii_partly_spelled(text, added):
    base, more = pii.find(text)
    assert not any(base.values())
    assert [(k, text[a:b]) for k in pii.KINDS for a, b in more[k]] == added


def test_pii_long_runs():
    assert pii.base_spans("0" * 5000 + "1.2.3.4")["ip"] == [(0, 5007)]
    pii.find("a dot " * 50_000)
    pii.find("one 2 " * 50_000)


def test_pii_base(spark, corpus):
    text = "a@b.co@d.e 1.2.3.4.5 300.1.1.1, 4111 1111 1111 1111 +1 (988) 555-2485 +12"
    base, _ = pii.find(text)
    assert {k: [text[a:b] for a, b in v] for k, v in base.items()} == {"email": ["a@b.co"], "ip": ["1.2.3.4"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (988) 555-2485 "[:-1]]}
    assert pii.mask(None) is None and pii.mask("x a@b.co y") == "x [email] y"
    got = pii.spans(make(spark, corpus)).collect()
    assert len(got) == len(corpus) and all(r.spans == "" for r in got)
    assert pii.spans(empty(spark)).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pii_against_brute_force(spark):
    """The contract's patterns by plain regular expressions, over random texts of their symbols and over a table."""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
    ]

    def base(text):
        return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]

    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(list("a@.0123456789  -+(x\n%é"), int(rng.integers(1, 60))))
        assert [(k, *s) for k, v in pii.find(text)[0].items() for s in v] == base(text), text
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.spans(docs).collect():
        want = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind, _, _ in rules)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_sharding(spark, corpus):
    got = sharding.placements(make(spark, corpus), bucket_rows=4).collect()
    assert len(got) == len(corpus)
    for s, rs in by_key(got, "shard").items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert all(r.grown_shard in (r["shard"], 8) for r in got)
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in corpus)
    again = sharding.placements(make(spark, corpus[::-1]), bucket_rows=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.placements(empty(spark)).count() == 0


def test_sharding_of_equal_rows(spark):
    """A hundred thousand equal rows, nulls throughout, beside others: slots stay gapless and equal ids share a shard."""
    d = spark.range(100_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "CAST(NULL AS string) AS text").unionByName(spark.range(3000).selectExpr("id % 500 AS doc_id", "CAST(id AS string) AS text"))
    p = sharding.placements(d, bucket_rows=1024).persist()
    got = p.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 103_000 and all(r["max(slot)"] + 1 == r["count(1)"] for r in got)
    assert p.select("shard", "slot").distinct().count() == 103_000
    assert p.groupBy("doc_id").agg({"shard": "max"}).count() == p.select("doc_id", "shard").distinct().count() == 501
    law = p.filter("doc_id IS NOT NULL").select("shard", "grown_shard").collect()
    assert any(r.grown_shard == 8 for r in law) and all(r.grown_shard in (8, r.shard) for r in law)


def test_fisher_yates(spark):
    from pyspark.sql import functions as F

    rows = spark.range(9).select("id", sharding.fisher_yates((F.col("id") * F.col("id") * 30).cast("int"), F.col("id")).alias("p")).collect()
    assert all(sorted(r.p or []) == list(range(30 * r.id**2)) for r in rows)
    three = spark.range(6000).select(sharding.fisher_yates(F.lit(3), F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(three) == 6 and all(850 < r["count"] < 1150 for r in three)


def test_written_shards(spark, corpus, tmp_path):
    d = make(spark, corpus).withColumnRenamed("h", "shard")
    sharding.write_shards(d, str(tmp_path / "o"), shards=3, bucket_rows=8)
    back = spark.read.parquet(str(tmp_path / "o"))
    got = back.collect()
    assert sorted(str(tuple(r[c] for c in d.columns)) for r in got) == sorted(str(tuple(r)) for r in d.collect())
    for _, rs in by_key(got, "shard_").items():
        assert sorted(r.slot_ for r in rs) == list(range(len(rs)))
    slots = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.placements(d.drop("shard"), shards=3, bucket_rows=8).collect()}
    assert slots == {(r.doc_id, zlib.crc32((r.text or "").encode()), r.shard_, r.slot_) for r in got}


def test_quality(spark, corpus):
    got = quality.verdicts(make(spark, corpus)).collect()
    assert len(got) == len(corpus)
    got = by_key(got)
    for i, t, _, _ in corpus:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r.kept and r.base_failed)
    assert quality.verdicts(empty(spark)).count() == 0


def test_quality_drops_symbol_soup(spark):
    plain = [(i, "plain words of prose that run on for a while without end " + "ab" * (i % 9), "en", "s") for i in range(80)]
    got = {r.doc_id: r.kept for r in quality.verdicts(make(spark, [*plain, (99, "### $$$ &&& " * 9 + "some words to pass the base rule here", "en", "s")])).collect()}
    assert not got[99] and all(got[i] for i in range(80))


def test_langid(spark, corpus):
    d = make(spark, corpus)
    dicts = langid.learn(d.filter("doc_id % 4 <> 2 OR doc_id IS NULL"))
    assert sorted(dicts) == ["en", "fr"]
    got = by_key(langid.predict(d, dicts).collect())
    assert got[400][0].lang_pred == got[402][0].lang_pred == "und"
    asked = [(i, lg) for i, _, lg, _ in corpus[:160] if i % 4 == 2]
    assert sum(got[i][0].lang_pred == lg for i, lg in asked) >= len(asked) - 1 and all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert langid.predict(empty(spark), langid.learn(empty(spark))).count() == 0
    kept = langid.accepted(d.withColumnRenamed("h", "judged"), dicts)
    assert kept.columns == d.withColumnRenamed("h", "judged").columns and kept.filter("text IS NULL").count() == 0


def test_langid_against_brute_force(spark, corpus):
    """Every row's language is the one whose dictionary compresses its letters best, each block by itself."""
    import zstandard as zstd

    d = make(spark, [*corpus, (700, "½ ² Ⅷ", "en", "s"), (701, "½ a", "en", "s"), (702, "le " * 40_000, "fr", "s")])
    dicts = langid.learn(d)
    for r in langid.predict(d, dicts).join(d.select("doc_id", "text").distinct(), "doc_id").collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw = " ".join(re.sub(r"[\W\d_]+", " ", r.text.lower()).split(" ")).encode()
        size = {}
        for k, v in dicts.items():
            c = zstd.ZstdCompressor(level=langid.LEVEL, dict_data=zstd.ZstdCompressionDict(v, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            size[k] = sum(len(c.compress(raw[i : i + langid.BLOCK_BYTES])) for i in range(0, len(raw), langid.BLOCK_BYTES))
        assert r.lang_pred == min(sorted(size), key=size.get)
        assert r.margin == sorted(size.values())[1] - min(size.values())
    assert {r.doc_id: r.lang_pred for r in langid.predict(d, dicts).filter("doc_id IN (700, 701)").collect()}[700] == "und"


def test_langid_sample_is_bounded(spark):
    """Every sampled text gives a chunk; copies count once; ends of long texts are drawn too."""
    rows = [(i, f"text{chr(97 + i % 26)} " * 200 + "tail", "en", "s") for i in range(300)] + [(1000 + i, "same words", "en", "s") for i in range(500)]
    rows += [(5000, "x" * 100_000 + "ENDMARK", "fr", "s")]
    got = langid.learn(make(spark, rows), rows=40, size=4096, chunk=512)
    assert 4096 <= len(got["en"]) <= 40 * 513 and len(got["fr"]) >= 4096
    whole = langid.learn(make(spark, rows), rows=40, size=200_000, chunk=512)
    assert b"endmark" in whole["fr"]


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 6)).round(1).tolist()
    rows = [(i, x, "z") for i, x in enumerate(v)] + [(100 + i, v[0], "z") for i in range(30)] + [(10, v[7], "z"), (10, v[10], "z"), (33, v[33], "z")]
    unfit = [(200, None, "z"), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], "z"), (202, [float("nan")] * 6, "z"), (None, v[3], "z"), (210, [1e300] + [0.0] * 5, "z"), (220, [-1e8] * 6, "z"), (230, [], "z")]
    d = spark.createDataFrame(rows + unfit, "vec_id long, embedding array<double>, score string")
    fit = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x, _ in rows]
    want = collections.Counter()
    for n, (q, a) in enumerate(fit):
        if q % 10 == 0:
            best = sorted((-int(a @ b), i, m) for m, (i, b) in enumerate(fit) if m != n)[:5]
            want.update((q, k + 1, i, -s) for k, (s, i, _) in enumerate(best))
    by_ten = F.col("vec_id") % 10 == 0
    for block in (16, None):
        got = topk.top_k(d, by_ten, block=block, query_block=4)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
    few = d.filter("vec_id < 3")
    assert topk.top_k(few, F.col("vec_id") == 0).count() == 2
    assert topk.top_k(d.limit(0), by_ten).count() == 0


def test_topk_query_is_the_sql(spark, tmp_path):
    import duckdb

    from orrery.llm import queries

    rng = np.random.default_rng(5)
    rows = [(i // 2, x) for i, x in enumerate(rng.normal(size=(300, 4)).round(1).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op5_topk"]).fetchall()
    got = [tuple(r) for r in queries.op5_topk(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 30


def components_of(fps, radius):
    root = {}
    todo = sorted(fps, key=lambda i: (fps[i], i))
    for s in sorted(fps):
        if s in root:
            continue
        stack = [s]
        root[s] = s
        while stack:
            x = stack.pop()
            for y in todo:
                if y not in root and (fps[x] ^ fps[y]).bit_count() <= radius:
                    root[y] = s
                    stack.append(y)
    return root


@pytest.mark.parametrize("radius, blocks", [(2, 5), (7, 10)])
def test_simhash(spark, corpus, radius, blocks):
    rows = [r for r in corpus if r[0] is not None]
    unnamed = simhash.assign(make(spark, [*corpus, (None, corpus[5][1], "en", "s")]), radius=radius, blocks=blocks).filter("doc_id IS NULL").collect()
    assert sorted(str(r.component_id) for r in unnamed) == ["5", "None"]  # null only where no row of the class has an id
    got = simhash.assign(make(spark, rows), radius=radius, blocks=blocks).collect()
    assert len(got) == len(rows)
    fps = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t, _, _ in rows}
    want = components_of(fps, radius)
    assert all(r.component_id == want[r.doc_id] and r.fp & (2**64 - 1) == fps[r.doc_id] for r in got)


def test_simhash_forest_of_many():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    f = np.unique(np.concatenate([base, *(base[rng.integers(0, 60, 2500)] ^ (np.uint64(1) << rng.integers(0, 64, 2500, dtype=np.uint64)) for _ in range(2))]))
    assert len(f) > 2048
    links = simhash.forest(f, 2)
    assert all(int(f[i] ^ f[j]).bit_count() <= 2 for i, j in links)
    assert len(f) - len(links) == 60


def test_wide_forest_joins_what_pairs_join():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (8, 3), dtype=np.uint64)
    f = base[rng.integers(0, 8, 900)].copy()
    for _ in range(14):
        f[np.arange(900), rng.integers(0, 3, 900)] ^= np.uint64(1) << rng.integers(0, 63, 900, dtype=np.uint64)
    for radius in (12, 22, 34):
        links = simhash.wide_forest(f, radius)

        def groups(pairs):
            root = list(range(900))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i, j in pairs:
                p, q = sorted((find(i), find(j)))
                root[q] = p
            return [find(i) for i in range(900)]

        near = np.argwhere(simhash.distances(f[:, None], f[None]) <= radius)
        assert groups(links) == groups(near.tolist())


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def test_simhash_finds_near_copies(spark):
    """Of pairs at similarity 0.8 and more in five-word shingles at least nine in ten are found, and none below 0.5."""
    rng = np.random.default_rng(5)
    rows, alike = [], []
    for g in range(240):
        ws = [f"w{x}" for x in rng.integers(0, 50_000, 400)]
        copy = list(ws)
        for at in rng.choice(400, int(rng.integers(6, 10)) if g % 2 else 70, replace=False):
            copy[at] = "changed"
        rows += [(2 * g, " ".join(ws), "en", "s"), (2 * g + 1, " ".join(copy), "en", "s")]
        alike.append(jaccard(ws, copy))
    kept = {r.doc_id for r in simhash.deduplicated(make(spark, rows)).collect()}
    assert set(range(0, 480, 2)) <= kept
    high = [2 * g + 1 not in kept for g, s in enumerate(alike) if s >= 0.8]
    assert len(high) > 80 and sum(high) >= 0.9 * len(high)
    assert all(2 * g + 1 in kept for g, s in enumerate(alike) if s < 0.5)


def test_simhash_large_places(spark):
    """A group of copies far above SMALL, each a word apart, is one component."""
    ws = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(ws[:i] + ["other"] + ws[i + 1 :]), "en", "s") for i in range(200)]
    assert [r.doc_id for r in simhash.deduplicated(make(spark, rows)).collect()] == [0]


def test_wide_fingerprint():
    """Bits over half of the shingles' hashes, whatever the length of the text."""
    h = simhash.WideHasher(5, 640)
    assert h(None) == h(" \n") == bytes(80) and h("A b") == h("a  B") != h("b a")
    text = " ".join(f"w{i % 211}" for i in range(3000))
    both = [np.unpackbits(np.frombuffer(h(t), np.uint8)) for t in (text, text + " more words here")]
    assert (both[0] != both[1]).sum() < 20 and 250 < both[0].sum() < 390
    lone = simhash.WideHasher(5, 72)(text)
    assert len(lone) == 16 and lone[9:] == bytes(7)


def test_simhash_keeps_one(spark, corpus):
    d = make(spark, [r for r in corpus if r[0] not in (None, 403)])
    kept = {r.doc_id for r in simhash.deduplicated(d).collect()}
    assert 5 in kept and not kept & set(range(300, 312)) and simhash.deduplicated(empty(spark)).count() == 0


def test_simhash_keeps_rows_of_null_and_repeated_ids(spark, corpus):
    more = [(None, "no id at all", "en", "s0"), (None, "another text without an id", "en", "s0"), (None, corpus[5][1], "en", "s0")]
    kept = simhash.deduplicated(make(spark, corpus + more)).collect()
    assert sorted(r.text for r in kept if r.doc_id is None) == ["another text without an id", "no id at all"]
    assert sum(r.doc_id == 403 for r in kept) == 1 and sum(r.text == corpus[5][1] for r in kept) == 1
    plain = simhash.deduplicated(make(spark, [r for r in corpus if r[0] not in (None, 403)])).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in plain} | {None, 403}


def test_mixing(spark, corpus):
    docs, slots = mixing.mix(make(spark, corpus), block=64)
    got = docs.collect()
    assert len(got) == len(corpus)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"] or r["size"] == 0 == r.taken
    names = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, rest, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            rest -= want[s]
        open_ -= over
    want |= {s: level * w[s] for s in open_}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) < 1.001
    used = collections.Counter()
    for r in slots.collect():
        used[r.source] += r.words
    assert used == taken
    again = mixing.mix(make(spark, corpus[::-1]), block=64)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty(spark))[0].count() == 0


def test_mixed_documents(spark, corpus):
    d = make(spark, [r for r in corpus if r[0] not in (None, 403)])
    taken = {r.doc_id: r.taken for r in mixing.mix(d, block=64)[0].collect()}
    words = collections.Counter()
    for r in mixing.mixed(d, block=64).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == collections.Counter({k: v for k, v in taken.items() if v})


def test_mixed_documents_of_null_and_repeated_ids(spark, corpus):
    d = make(spark, corpus + [(405, "w1 w2 w3 " * 3000, "en", "s0"), (None, "no id at all", "fr", None)])
    taken, words = collections.Counter(), collections.Counter()
    for r in mixing.mix(d, block=64)[0].collect():
        taken[r.doc_id, r.source] += r.taken
    for r in mixing.mixed(d, block=64).collect():
        words[r.doc_id, r.source] += len(WORD.findall(r.text))
    assert (None, "s0") in words and (None, None) in words and words == +taken


def repeated_passages(texts):
    """Per text, the runs of words under 51-word strings that another of the texts (by place) holds too."""
    ws = [WORD.findall(t or "") for t in texts]
    of = collections.defaultdict(set)
    for i, w in enumerate(ws):
        for k in range(len(w) - 50):
            of[tuple(w[k : k + 51])].add(i)
    out = []
    for w in ws:
        at = [k for k in range(len(w) - 50) if len(of[tuple(w[k : k + 51])]) > 1]
        out.append(sum(k - 51 > j for j, k in zip(at, at[1:])) + bool(at))
    return out


def marked_bytes(raws):
    seen = collections.Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399))
    for r in raws:
        m = np.zeros(len(r) + 1, int)
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                m[i] += 1
                m[i + 400] -= 1
        yield np.cumsum(m)[: len(r)] > 0


def test_suffix(spark, corpus):
    rng = np.random.default_rng(8)
    ws = [f"v{x}" for x in rng.integers(0, 900, 2000)]
    passage, other = ws[:60], ws[100:170]
    more = [(600, " ".join(ws[200:300] + passage + ws[300:380]), "en", "s"), (601, "\n".join(ws[400:440] + passage + ws[450:470] + other), "en", "s"), (602, "\t".join(other + ws[500:530] + passage + ws[560:570] + passage), "en", "s"), (603, " ".join(ws[600:660] * 2), "en", "s"), (604, " ".join(passage[:50]), "en", "s")]
    rows = corpus + more
    raws = [(t or "").encode() for _, t, _, _ in rows]
    passages = repeated_passages([t for _, t, _, _ in rows])
    assert passages[len(corpus) :] == [1, 2, 3, 0, 0]
    for hot, batch in ((20_000, 1024), (1, 1024), (20_000, 3)):
        d = make(spark, rows)
        got = suffix.deduplicated(d, hot=hot, batch=batch).collect()
        assert len(got) == len(rows)
        got = by_key(got)
        for (k, *_), r, c, n in zip(rows, raws, marked_bytes(raws), passages):
            kept = hashlib.sha256(np.frombuffer(r, np.uint8)[~c].tobytes()).hexdigest()
            x = got[k][0]
            assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, x.n_passages) == (len(r), c.sum(), np.sum(np.diff(np.r_[0, c.astype(int)]) == 1), kept, n)
    full = {(r.doc_id, bytes(r.kept)) for r in suffix.cleaned(d).collect()}
    assert full == {(k, np.frombuffer(r, np.uint8)[~c].tobytes()) for (k, *_), r, c in zip(rows, raws, marked_bytes(raws))}
    assert suffix.deduplicated(empty(spark)).count() == 0


def listed(texts):
    b = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    return [r for x in suffix._list_anchors(suffix.LENGTH, suffix.GRAM)(iter([b])) for r in x.to_pylist()]


def test_suffix_joins_short_texts(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in rng.integers(0, 260, 300)]
    texts[3:3] = [None, "", " \t\n" * 60, "é" * 300, "x" * 399, "y" * 400, "z " * 51, " \n" + "v w " * 200 + "\n", "u" * 2000, "\r" * 500]
    alone = [r for t in texts for r in listed([t])]
    rounds = []
    sums = suffix.Roller._sums
    monkeypatch.setattr(suffix.Roller, "_sums", lambda self, values: rounds.append(len(values)) or sums(self, values))
    order = lambda rows: sorted(tuple(r.values()) for r in rows)
    assert order(listed(texts)) == order(alone) and len(alone) > 300
    assert len(rounds) < len(texts) / 10
    # every string picks one anchor, and equal strings the same place in them
    for t in texts[:60]:
        rows, raw = [r for r in listed([t]) if r["unit"] == suffix.BYTES], (t or "").encode()
        assert sorted(x for r in rows for x in range(r["lo"], r["hi"] + 1)) == list(range(len(raw) - 399))


def test_suffix_levels_of_clashing_hashes():
    rng = np.random.default_rng(10)
    h, c, text = (rng.integers(0, n, 600) for n in (40, 6, 3))
    levels, seen = suffix.Levels(), np.zeros(600, bool)
    for o in range(0, 600, 50):
        at = np.arange(o, o + 50)
        levels.add(h[at].astype(np.uint64), c[at].astype(np.uint64), at, -1 - at, seen)
    many = collections.Counter(zip(h.tolist(), c.tolist()))
    assert seen.tolist() == [many[k] > 1 for k in zip(h.tolist(), c.tolist())]
    levels, seen = suffix.Levels(), np.zeros(600, bool)
    for o in range(0, 600, 50):
        at = np.arange(o, o + 50)
        levels.add(h[at].astype(np.uint64), c[at].astype(np.uint64), at, text[at], seen)
    of = collections.defaultdict(set)
    for k in zip(h.tolist(), c.tolist(), text.tolist()):
        of[k[:2]].add(k[2])
    met = {(h[i], c[i], text[i]) for i in np.flatnonzero(seen)}  # one of a text's equal strings is enough
    assert met == {(*k, t) for k, ts in of.items() if len(ts) > 1 for t in ts}


def test_suffix_family_meets_earlier_batches(spark, corpus, tmp_path):
    rows = list({t: r for r in corpus if (t := r[1]) and len(t) >= 400}.values())
    family = suffix.Family(spark, str(tmp_path / "family"))
    marks = collections.defaultdict(set)
    for i in range(0, len(rows), 30):
        for r in family.add(make(spark, rows[i : i + 30])).filter("unit = 0").collect():
            marks[bytes(r.tid)] |= set(range(r.a, r.b))
        if i == 30:
            family = suffix.Family.open(spark, family.path, family.step)
    raws = [t.encode() for _, t, _, _ in rows]
    for r, c in zip(raws, marked_bytes(raws)):
        assert marks[hashlib.sha256(r).digest()[:16]] == set(np.flatnonzero(c).tolist())
    sizes = [n for _, n in family.levels]
    assert len(sizes) <= 1 + np.log2(len(rows) / 30 + 1) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert family.add(make(spark, rows[:5])).count() == 0


def test_licences(spark, corpus):
    rows = [(1, "prose\nReleased under the MIT License.\nmore", "en", "s"), (2, "He lost his driving license.", "en", "s"), (3, "Licensed under the Apache License, Version 2.0.", "en", "s"), (4, "Licensed under CC BY-NC 4.0.", "en", "s"), (5, "This work is licensed under the GNU General Public License, version 3.", "en", "s"), (None, "Released under the MIT License.", None, None), (1, "prose\nReleased under the MIT License.\nmore", "en", "s")]
    got = licences.scan(make(spark, rows + corpus)).collect()
    assert len(got) == len(rows) + len(corpus)
    named = sorted((str(r.doc_id), r.family) for r in got if r.family)
    assert named == sorted([("1", "mit"), ("1", "mit"), ("3", "apache"), ("4", "cc-by-nc"), ("5", "gpl"), ("None", "mit")])
    assert licences.scan(empty(spark)).count() == 0


PROSE = "the river ran past the old mill and over the stones while people of the town went on with their work in the rain "
LONG_NOTICES = [
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "mit"),
    (PROSE + "Licensed under the Apache License, Version 2.0. " + PROSE, "apache"),
    (PROSE * 40 + "Released under the MIT License. " + PROSE * 40, "mit"),
    (PROSE + "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. " + PROSE, "cc-by-nc"),
    (PROSE + "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3. " + PROSE, "agpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
]


def test_licences_in_long_paragraphs(spark):
    rows = [(i, t, "en", "s") for i, (t, _) in enumerate(LONG_NOTICES)]
    two = (90, "Licensed under the Apache License, Version 2.0. " + PROSE + "Released under the MIT License.", "en", "s")
    none = [(91, PROSE * 9 + "He lost his driving license. " + PROSE * 9, "en", "s"), (92, "Permission is granted. " + PROSE * 3 + "a copy of this license", "en", "s")]
    got = {r.doc_id: r for r in licences.scan(make(spark, [*rows, two, *none])).collect()}
    assert [got[i].families for i in range(len(rows))] == [f for _, f in LONG_NOTICES]
    assert [got[i].family for i in range(len(rows))] == [f for _, f in LONG_NOTICES]
    assert got[90].families == "apache,mit" and got[90].n_confirmed == 1
    assert got[91].family is None and got[92].family is None


UNSEEN = [
    ("This file is part of Foo. Foo is free software: you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "gpl"),
    ("The code is distributed under the GPL version 2 or later, see COPYING.", "gpl"),
    ("GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", "gpl"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "mit"),
    ("Our project is licensed under the terms of the MIT license - see the file.", "mit"),
    ("Licensed under the Apache License,\nVersion 2.0 (the License); you may not use this file\nexcept in compliance with the License.", "apache"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "boost"),
    ("Copyright 2019 by the publisher. All rights reserved.", "proprietary"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "bsd"),
    ("Text is available under the Creative Commons Attribution-ShareAlike License; terms may apply.", "cc-by-sa"),
    ("Subject to the terms of the Mozilla Public License, v. 2.0, this form is shared.", "mpl"),
    ("this library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation", "lgpl"),
]
OTHERS = ["The general public was free to modify its plans as published by the foundation.", "A license to drive is required for any person under the terms of the law.", "The river is provided with water of any kind, and fish.", "All rights were discussed by the members of the public.", "He may not use this file cabinet except in the morning.", "The conditions are met when the following list is complete.", "Version 2.0 of the museum opened in January 2004.", "The authors of the software spoke about a particular purpose."]


def test_licences_of_unseen_wordings(spark):
    """Held-out precision and recall: none of these wordings is a notice of the module."""
    rows = [(i, "Some prose before.\n\n" + t + "\n\nSome prose after.", "en", "s") for i, (t, _) in enumerate(UNSEEN)] + [(100 + i, t, "en", "s") for i, t in enumerate(OTHERS)]
    got = {r.doc_id: r.family for r in licences.scan(make(spark, rows)).collect()}
    found = [(want, got[i]) for i, (_, want) in enumerate(UNSEEN)]
    right = sum(a == b for a, b in found)
    named = sum(v is not None for v in got.values())
    assert right >= 0.9 * len(UNSEEN), found
    assert right >= 0.9 * named, got


def test_licences_against_brute_force(spark, corpus):
    """Paragraphs that the classifier names, each weighed here in plain Python; candidates by every 3-gram of every notice."""
    classes, weights, bias, least = licences.train()
    notices = collections.defaultdict(set)
    for family, i, g, _ in licences.templates():
        notices[family, i].add(g)
    every = set().union(*notices.values())
    rows = [(i, t, "en", "s") for i, (t, _) in enumerate(UNSEEN)] + [(100 + i, t, "en", "s") for i, t in enumerate(OTHERS)] + [(200 + i, "a\n \nb " + t + "\n\n\n\n" + t, "en", "s") for i, (t, _) in enumerate(UNSEEN)] + [(1000 + i, t, lg, s) for i, (_, t, lg, s) in enumerate(corpus)]
    lone = 0
    for r in licences.scan(make(spark, rows)).join(make(spark, rows).select("doc_id", "text").distinct(), "doc_id").collect():
        whole, n = set(), 0
        for p in re.split(r"\n[ \t\r]*\n", r.text or ""):
            ws = licences.tokens(p)
            three = {" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)}
            n += bool(three & every)
            z = np.array(bias) + sum((np.array(weights[g]) for g in set(licences.grams(ws)) if g in weights), np.zeros(len(classes)))
            z = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            family = classes[int(z.argmax())]
            if three & every and family != licences.UNKNOWN and z.max() >= least and max(len(three & g) for (f, _), g in notices.items() if f == family) >= licences.CONFIRM * len(three):
                whole.add(family)
        assert r.n_paragraphs == n
        assert whole <= set(r.families.split(","))
        lone += bool(whole)
    assert lone >= 8


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    odd = [(500, "a<|endoftext|>b <|ENDOFTEXT|>", "en", "s"), (501, "Straße ÉTÉ don't 日本 x² K é", "fr", "s")]
    rows = corpus + odd
    got = packing.pack(packing.pieces(make(spark, rows), tokenizer())).collect()
    by = by_key(got)
    for i, t, _, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(array("I", ids[s : s + 4096]).tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        assert {(r.piece, r.start, r["length"], r.ids_crc32) for r in by[i]} == set(want)
    total = 0
    for rs in by_key(got, "sequence_id").values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total += 1
    assert total <= -(-sum(r["length"] for r in got) // 4096) + 2
    assert packing.pack(packing.pieces(empty(spark), tokenizer())).count() == 0


def test_packed_sequences_hold_the_ids(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    got = packing.pack(packing.pieces(make(spark, corpus), tokenizer())).collect()
    assert all(len(r.ids) == 4 * r["length"] and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    by = by_key(got)
    for i, t, _, _ in corpus:
        if i not in (None, 403):
            assert b"".join(r.ids for r in sorted(by[i], key=lambda r: r.piece)) == array("I", tok.encode(t or "", add_special_tokens=False).ids + [1]).tobytes()


def test_packing_capacities():
    n = np.array([5, 4, 3, 3, 2, 2, 1, 10])
    bins, _ = packing.best_fit(n, 10)
    assert bins.max() == 2
    bins, _ = packing.best_fit(n, 10, max_docs=2)
    assert np.bincount(bins).max() <= 2
    bins, _ = packing.best_fit(n, 10, max_attention=100, rule="dot")
    assert max(np.bincount(bins, n.astype(float) ** 2)) <= 100


def test_merge_agrees_with_the_vocabulary():
    """The rank merge is exact if every plain token of the vocabulary encodes to itself."""
    import json

    e = packing.WordEncoder(tokenizer())
    vocab = json.load(open(tokenizer(), encoding="utf-8"))["model"]["vocab"]
    plain = [(t[:-4], i) for t, i in vocab.items() if t.endswith("</w>") and re.fullmatch("[a-z]+", t[:-4])]
    assert len(plain) > 20_000
    got = e.words([w.encode() for w, _ in plain])
    assert got == [array("I", [i]).tobytes() for _, i in plain]
