"""op11, op12 and op13 against plain versions and their SQL, on odd rows and on hot groups."""

import hashlib
import json
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkloom.llm import divergence_audit, exact_dedup, token_alignment
from sparkloom.llm.textbatch import Texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run int, digest long, block long, term string, n int"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(texts, rng):
    return [(i if i % 17 else None, t, rng.choice(["en", "de", None, "xx"]), rng.choice(["s0", "s1", "S1", None, "é"]), None, 1, 2, 3, "k", 4) for i, t in enumerate(texts)]


def odd_texts(rng):
    words = ["Alpha", "alpha", "ÉTÉ", "été", "İ", "漢字", "the", "stone", "Stone", "<|endoftext|>", "</s>", "▁", "don't", "1234", "🙂", "ß"]
    texts = [None, "", " ", "\n", "\n\n  x", "A", "a", "İ", "i̇", "é" * 400, "漢" * 3000, "word " * 5000, "<s>", "a b　c", "x" * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    return texts + texts[5:25]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return rows_of(odd_texts(rng), rng)


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bag(frame, columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def duck_bag(sql, rows, columns):
    con = duckdb.connect()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    con.register("documents", pa.table({c: pa.array([r[i] for r in rows], types[SCHEMA.split(", ")[i].split()[1]]) for i, c in enumerate(names)}))
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(columns)
    return Counter(tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall())


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# ---- op11


def plain_groups(text, tok, sp, bodies):
    """[(ids of A, ids of B)] by both libraries over the whole text; None where the bytes differ."""
    if not text:
        return None
    raw = (" " + text).encode()
    sides = []
    for ids, body in ((tok.encode(" " + text, add_special_tokens=False).ids, bodies[0]), (sp.encode(text), bodies[1])):
        if b"".join(body[i] for i in ids) != raw:
            return None
        sides.append((ids, np.cumsum([len(body[i]) for i in ids]).tolist()))
    (a, ends_a), (b, ends_b) = sides
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = i, j
        while i < len(a) and ends_a[i] <= cut:
            i += 1
        while j < len(b) and ends_b[j] <= cut:
            j += 1
        out.append((a[x:i], b[y:j]))
    return out


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=PIECE)
    plain = list(b"!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~") + [*range(161, 173), *range(174, 256)]
    other = {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)} | {chr(b): b for b in plain}
    byte = {i: bytes(other[c] for c in t) for t, i in json.load(open(BYTE))["model"]["vocab"].items()}
    piece = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return tok, sp, (byte, piece)


def plain_alignment(texts, libraries):
    groups = [plain_groups(t, *libraries) for t in texts]
    pairs = [Counter() if g is None else sum((Counter((x, y) for x in a for y in b) for a, b in g), Counter()) for g in groups]
    count = Counter(p for found in pairs for p in found)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for g, found in zip(groups, pairs, strict=True):
        if g is None:
            yield 0, 0, 0, 0, 0, 0, ""
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        links = sum(found.values())
        yield sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), links, sum(n for p, n in found.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in found.items()), hashlib.sha256(text.encode()).hexdigest()


def test_shared_cuts_against_sets():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = np.array(sorted({*rng.sample(range(1, 200), rng.randint(1, n)), 200}))
        b = np.array(sorted({*rng.sample(range(1, 200), rng.randint(1, n)), 200}))
        low = np.array(sorted(rng.sample(range(len(a)), min(len(a), 3))))
        high = np.append(low[1:], len(a))
        assert token_alignment.shared_cuts(a, b, low, high).tolist() == [i for i in range(low[0], len(a)) if a[i] in set(b.tolist())]


def test_long_stretch_without_cut_is_one_group():
    a, b = np.append(np.arange(2, 40_000, 2), 40_000), np.append(np.arange(3, 40_000, 6), 40_000)
    assert token_alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1])).tolist() == []


def test_alignment_against_the_libraries(odd, rows, libraries):
    texts = [r[1] for r in rows]
    found = token_alignment.token_alignment(odd)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((r[0], *x) for r, x in zip(rows, plain_alignment(texts, libraries), strict=True))
    assert as_bag(found, found.columns) == want


def test_blocks_of_any_size_give_the_same(odd, rows, libraries, monkeypatch):
    x = token_alignment.Aligned.of(token_alignment.spaced(Texts.of([r[1] for r in rows])), *token_alignment.encoders(BYTE, PIECE))
    whole = Counter()
    for t, code, n in zip(*(v.tolist() for v in x.links()), strict=True):
        whole[t, code] += n
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", 7)
    parts = Counter()
    for t, code, n in zip(*(v.tolist() for v in x.links()), strict=True):
        parts[t, code] += n
    assert parts == whole


def test_parts_bound_the_memory_and_give_the_same_block(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(450)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found, peaks = [], []
    for most in (token_alignment.PART_BYTES, token_alignment.BLOCK_BYTES):
        monkeypatch.setattr(token_alignment, "PART_BYTES", most)
        list(token_alignment.block_rows(iter([batch]), (BYTE, PIECE), 7))
        tracemalloc.start()
        found.append(pa.Table.from_batches(token_alignment.block_rows(iter([batch]), (BYTE, PIECE), 7)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert 1_500_000 < sum(map(len, texts)) < token_alignment.BLOCK_BYTES and found[0].num_rows == 1
    assert found[0].equals(found[1])
    assert peaks[0] < 0.6 * peaks[1], peaks
    assert max(x.cache.most for x in token_alignment.encoders(BYTE, PIECE)) <= 300_000


def test_groups_hold_spans_and_ids(odd, rows, libraries):
    found = token_alignment.aligned_groups(odd.where("doc_id IS NOT NULL")).collect()
    want = {r[0]: plain_groups(r[1], *libraries) for r in rows if r[0] is not None}
    for r in found:
        assert [(g.a, g.b) for g in r.groups] == (want[r.doc_id] or [])
        ends = [0, *[g.end for g in r.groups]]
        assert [g.start for g in r.groups] == ends[:-1]


def test_alignment_query(spark, rows, libraries, tmp_path):
    found = token_alignment.op11_alignment(spark, written(spark, tmp_path, rows))
    want = Counter((r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows], libraries), strict=True))
    assert as_bag(found, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]) == want


def test_alignment_of_nothing(nothing):
    assert token_alignment.token_alignment(nothing).collect() == [] == token_alignment.aligned_groups(nothing).collect()


# ---- op12

OP12 = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_dedup_against_sql(spark, rows, tmp_path):
    got = exact_dedup.op12_exact_dedup(spark, written(spark, tmp_path, rows))
    assert as_bag(got, OP12) == duck_bag(exact_dedup.OP12_SQL, rows, OP12)


def test_many_runs_merge_in_rounds(spark):
    # 600 runs take three rounds; a third of the rows are one text
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text")).repartition(600)
    got = exact_dedup.exact_groups(docs, keep="smallest").collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r.text.lower()].append(r.doc_id)
    sizes = {hashlib.sha256(t.encode()).digest(): (min(ids), len(ids)) for t, ids in want.items()}
    assert all((r.keep_id, r.group_size) == sizes[bytes(r.sha)] and r.kept == (r.id == r.keep_id) for r in got) and len(got) == 6000


def test_equal_digests_of_different_texts_stay_apart(spark):
    runs = spark.createDataFrame([(0, 5, b"x", 1, 1, (True, 3, 0)), (1, 5, b"y", 1, 1, (True, 9, 1)), (2, 5, b"x", 1, 4, (True, 7, 2)), (3, 5, b"x", 2, 1, (True, 8, 3))], "run int, digest long, sha binary, size int, n long, stays struct<has_id:boolean,id:long,row:long>")
    got = {(bytes(r.sha), r["size"]): (r.n, r.stays.id) for r in exact_dedup.merged(runs, "largest").collect()}
    assert got == {(b"x", 1): (5, 7), (b"y", 1): (1, 9), (b"x", 2): (1, 8)}


def test_deduplicate_keeps_whole_rows(odd, rows):
    kept = exact_dedup.deduplicate(odd, keep="largest")
    assert kept.columns == odd.columns
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    want = {}
    for r in rows:
        k = fold(r[1])
        want[k] = max(want.get(k, -1), -1 if r[0] is None else r[0])
    got = kept.collect()
    assert Counter((fold(r.text), -1 if r.doc_id is None else r.doc_id) for r in got) == Counter(want.items())


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).collect() == [] == exact_dedup.deduplicate(nothing).collect()
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(nothing, keep="first")


# ---- op13

OP13 = ["lang", "source", "part", "item", "value", "rank"]


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(4)
    terms = sorted({bytes(rng.choice(b"ab\xc3\xa9z") for _ in range(rng.randint(1, 7))) for _ in range(900)})
    machine = divergence_audit.Transducer.from_bytes(divergence_audit.Transducer.build(terms).to_bytes())
    asked = terms + [t + b"q" for t in terms] + [b"", b"\xff"]
    place = {t: i for i, t in enumerate(terms)}
    assert machine.ordinals(asked).tolist() == [place.get(t, -1) for t in asked]
    # as many states as there are different sets of continuations
    after = {t[:i]: None for t in terms for i in range(len(t) + 1)}
    assert len(machine.final) == len({frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in after})
    empty = divergence_audit.Transducer.build([])
    assert empty.ordinals([b"a", b""]).tolist() == [-1, -1]
    with pytest.raises(ValueError):
        divergence_audit.Transducer.build([b"b", b"a"])


def test_exact_smoothing_of_large_counts():
    count, total = np.array([0, 5, 10**14, 8 * 10**15 - 9]), np.array([3, 7, 3 * 10**14 + 1, 8 * 10**15])
    assert divergence_audit.smoothed(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(n) for c, n in zip(count, total, strict=True)]


def corpus(rng):
    words = [f"{a}{b}" for a in ("Ta", "ké", "lo", "mur") for b in ("n", "ra", "Ö", "st", "漢")]
    out = []
    for i in range(400):
        lang = rng.choice(["en", "en", "de", None, "zz"])
        n = 0 if lang == "zz" else rng.randint(0, 12)
        source = rng.choice(["s0", "s1", "S1", None, "é"])
        shift = len(source or "")
        text = None if rng.random() < 0.03 else " ".join(words[min(len(words) - 1, int(rng.expovariate(0.2)) + shift)] + rng.choice(["", ".", "1", "-x"]) for _ in range(n))
        out.append((i if i % 9 else None, text, lang, source, None, 1, 2, 3, "k", 4))
    return out + out[:7]


def test_audit_against_sql(spark, tmp_path, monkeypatch):
    rows = corpus(random.Random(8))
    where = written(spark, tmp_path, rows)
    want = duck_bag(divergence_audit.OP13_SQL, rows, OP13)
    assert sum(k[2] == "term" for k in want) > 20
    assert as_bag(divergence_audit.op13_source_audit(spark, where), OP13) == want


def test_slices_of_transducers_and_small_shards(spark, monkeypatch):
    rows = corpus(random.Random(9))
    docs = divergence_audit._clean(spark.createDataFrame(rows, SCHEMA))
    kept = divergence_audit.kept_terms(docs, 5).checkpoint()
    flat = lambda x: x.select("lang", "source", "task", "block", F.explode(F.arrays_zip("ordinals", "counts")).alias("c")).select("lang", "source", "task", (F.col("block") * divergence_audit.BLOCK + F.col("c.ordinals")).alias("ordinal"), "c.counts")
    columns = ["lang", "source", "task", "ordinal", "counts"]
    one = as_bag(flat(divergence_audit.recount(docs, divergence_audit.transducers(kept).checkpoint())), columns)
    assert len(one) > 50 and {k[2] for k in one} == {0}
    # many slices of small shards, merged two tasks at a time
    monkeypatch.setattr(divergence_audit, "FAN", 2)
    assert as_bag(flat(divergence_audit.recount(docs, divergence_audit.transducers(kept, 3).checkpoint(), 3, 900)), columns) == one
    words = Counter()
    for r in rows:
        words.update((r[2] or "", r[3] or "", t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")))
    place = {(r.lang, r.term): r.ordinal for r in kept.collect()}
    assert {(k[0], k[1], 0, place[k[0], k[2]], n): 1 for k, n in words.items() if (k[0], k[2]) in place} == dict(one)


def test_audit_without_terms_and_of_nothing(spark, nothing):
    assert divergence_audit.source_divergence(nothing).collect() == []
    few = spark.createDataFrame([(1, "one", "en", "b"), (2, None, "en", "a"), (3, "", None, None)], "doc_id long, text string, lang string, source string")
    got = as_bag(divergence_audit.source_divergence(few), OP13)
    assert got == Counter({("en", "a", "pair", "b", 0, 1): 1, ("en", "b", "pair", "a", 0, 1): 1})
