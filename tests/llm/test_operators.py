"""Every operator against a plain version, and on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import fingerprints, language_id, license_scan, mixing, order_minhash, pieces, quality_crf, quality_rules, token_codes, toxicity
from sparkloom.llm.textbatch import Interner, Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string, n int"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "stone", "river", "light", "green", "house", "paper"]) + str(rng.randint(0, 40)) for _ in range(n))


def odd_rows(rng):
    long = "\n".join(sentence(rng, 12) + "." for _ in range(300))
    texts = [None, "", " ", "\n\n", "a", "one two three four", "é ñ 漢字 😀", "x" * 5000, long, long, sentence(rng, 40), sentence(rng, 40) + "\x1c  end ", "### %% $$", "THE THE THE THE THE THE THE THE THE THE THE THE"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None, 7, 0.5, "k", 1) for i, t in enumerate(texts)]
    return [*rows, (None, "text without id and some more words here", "en", "s1", 3, 7, 0.5, "k", 1), rows[10], rows[10]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(random.Random(5)), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_lines_and_hashes():
    texts = ["a b\nc", "", "a\n", "\n\nx", "b", "é\tb  c"]
    t = Texts.of(texts)
    s, e, at = t.words()
    for i, x in enumerate(texts):
        assert t.strings(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]) == WORD.findall(x)
    s, e, at = t.lines()
    for i, x in enumerate(texts):
        assert t.strings(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]) == x.split("\n")
    s, e, _ = t.words()
    h = Texts.span_hash(t.prefix_hash(), s, e)
    assert [len({int(x) for x, w in zip(h, t.strings(s, e), strict=True) if w == v}) for v in ("b", "c")] == [1, 1]
    assert len(set(h.tolist())) == len(set(t.strings(s, e)))
    interner = Interner(most=3)
    codes, first = interner.codes(h)
    assert len(first) == len(set(h.tolist())) and codes.max() == len(first) - 1


# ---- 1


def test_license_scan(spark, odd, nothing):
    rng = random.Random(1)
    mit = license_scan.TEMPLATES["MIT"]
    set_out = mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS PROVIDED", "\n\nTHE SOFTWARE IS PROVIDED")
    rows = [
        (1, f"{sentence(rng, 30)}\nReleased under the MIT License.\n{sentence(rng, 20)}"),
        (2, mit.replace("Software", "software") + " thanks"),
        (3, f"{sentence(rng, 9)}\n\n{mit[:400]}\n{mit[400:]}\n\n{sentence(rng, 9)}"),
        (4, sentence(rng, 50)),
        (5, "the license of the software is under the version"),
        (6, f"{sentence(rng, 30)}\n\n{set_out}\n\n{sentence(rng, 30)}"),
        (7, f"{sentence(rng, 30)}\n \t\n{set_out.replace(chr(10) * 2, chr(10) + ' ' + chr(10))}\n\n\n{sentence(rng, 30)}"),
        (8, license_scan.TEMPLATES["BSD-3-Clause"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS") + f"\n\n{sentence(rng, 200)}"),
    ]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert out[1]["__license"] == "MIT-line" and out[1]["__license_lines"] == 1 and out[1]["__license_dice"] == 1.0
    assert out[2]["__license"] == out[3]["__license"] == "MIT"
    assert out[4]["__license"] is None and out[5]["__license"] is None
    assert out[6]["__license"] == out[7]["__license"] == "MIT" and out[6]["__license_dice"] == out[7]["__license_dice"] == 1.0
    assert out[8]["__license"] == "BSD-3-Clause" and out[8]["__license_dice"] == 1.0
    assert license_scan.scan(odd, odd.columns).count() == odd.count()
    assert license_scan.scan(nothing, ["doc_id"]).count() == 0


def test_license_scan_matches_its_sql(spark, odd, tmp_path):
    rng = random.Random(8)
    bodies = list(license_scan.TEMPLATES.values())

    def text():
        parts = []
        for _ in range(rng.randint(1, 6)):
            body = rng.choice(bodies).split(" ")
            cuts = sorted(rng.sample(range(1, len(body)), min(rng.randint(0, 3), len(body) - 1)))
            for i, j in zip([0, *cuts], [*cuts, len(body)], strict=True):
                parts.append(" ".join(body[i:j]))
                parts.append(rng.choice(["\n\n", "\n", "\n \r\n", "\n\n\n", " ", "\n\x0b\n"]))
            parts.append(rng.choice(["", sentence(rng, 5), "\n\n" + sentence(rng, 30) + "\n\n", "\n\n\n"]))
        return "".join(parts)

    own = spark.createDataFrame([(1000 + i, text()) for i in range(60)], "doc_id long, text string")
    odd.select("doc_id", "text").unionByName(own).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(license_scan.OP1_SQL)
    got = license_scan.op1_licenses(spark, str(tmp_path)).select(*want.columns).collect()
    row = lambda r: (r[0], r[1], round(r[2], 9), r[3])
    assert sorted(map(row, got), key=repr) == sorted(map(row, want.fetchall()), key=repr)
    assert sum(r[1] is not None for r in got) > 40


# ---- 2


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    n = [3, 1, 4]
    at = np.concatenate([[0], np.cumsum(n)])
    unary, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, logz = quality_crf.forward_backward(unary, at, trans)
    total, pairs = 0.0, np.zeros((2, 2))
    for d in range(3):
        weights, marg, two = [], np.zeros(n[d]), np.zeros((2, 2))
        for y in np.ndindex(*([2] * n[d])):
            w = np.exp(sum(unary[at[d] + i] * y[i] for i in range(n[d])) + sum(trans[y[i], y[i + 1]] for i in range(n[d] - 1)))
            weights.append(w)
            marg += w * np.array(y)
            for i in range(n[d] - 1):
                two[y[i], y[i + 1]] += w
        z = sum(weights)
        pairs += two / z
        total += np.log(z)
        assert np.allclose(good[at[d] : at[d + 1]], marg / z)
    assert np.isclose(total, logz) and np.allclose(pair, pairs)


def quality_rows(rng, n):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        lines = [sentence(rng, 10) + "." for _ in range(8)]
        if bad:
            lines = [lines[0]] + [" ".join(w + "%%%" for w in x.split()) for x in lines[1:]]
        rows.append((i, "\n".join(lines), 0 if bad else 1))
    return rows


def test_quality_holds_out(spark, odd, nothing):
    rows = quality_rows(random.Random(2), 300)
    train, test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5], [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 5]
    model = quality_crf.fit([r[1] for r in train], np.array([r[2] for r in train]))
    score = model.score(model.quality(Texts.of([r[1] for r in test]))[0])
    assert all((s >= 0.3) == bool(r[2]) for s, r in zip(score, test, strict=True))
    out = quality_crf.score(odd, model, odd.columns).collect()
    assert len(out) == odd.count() and all(0 <= r["__score"] <= 1 for r in out)
    assert quality_crf.score(nothing, model, ["doc_id"]).count() == 0
    assert quality_crf.fit([], np.zeros(0)).score(quality_crf.fit([], np.zeros(0)).quality(Texts.of(["x"]))[0])[0] == 1.0


# ---- 3


def test_fingerprints_follow_similarity(spark, odd, nothing):
    rng = random.Random(3)
    rows = [(i * 3, sentence(rng, rng.randint(60, 300))) for i in range(60)] + [(1000, ""), (1001, "a b"), (1002, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    near = fingerprints.with_next(fingerprints.with_fingerprint(docs), "doc_id", ["text", "__fp"])
    got = {r.doc_id: r for r in near.withColumn("near", fingerprints.likeness(F.col("__fp"), F.col("next___fp"))).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(sorted(rows)):
        assert got[i].next_text == sorted(rows)[(k + 1) % len(rows)][1]
    assert got[1001].near == 1.0 and got[1000].near == 0.0 and list(got[1001]["__fp"]) == list(got[1002]["__fp"])
    grams = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    pairs = []
    for _ in range(60):
        w = sentence(rng, 300).split()
        v = w[: rng.randint(10, 300)] + sentence(rng, 100).split()
        pairs.append((" ".join(w), " ".join(v)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("j"))
    err = [r.j - len(grams(r.a) & grams(r.b)) / len(grams(r.a) | grams(r.b)) for r in df.collect()]
    assert abs(np.mean(err)) < 0.02 and np.sqrt(np.mean(np.square(err))) < 0.05
    assert fingerprints.with_next(fingerprints.with_fingerprint(odd), "doc_id", ["text", "__fp"]).count() == odd.count()
    assert fingerprints.with_next(fingerprints.with_fingerprint(nothing), "doc_id", ["text", "__fp"]).count() == 0


def test_edited_texts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(0, 50)) + "é😀") for i in (4, 9, 2, 70)] + [(11, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op3_fingerprints(spark, str(tmp_path)).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)


def plain_fingerprint(text):
    """The packed bins in hexadecimal, step by step."""
    def h(raw, seed=42):
        return xxhash.xxh64_intdigest(raw, seed)

    words = [h(w.encode()) for w in WORD.findall(text or "")]
    if not words:
        return ""
    windows = []
    for i in range(max(1, len(words) - 4)):
        seed = 42
        for w in words[i : i + 5]:
            seed = h(w.to_bytes(8, "little"), seed)
        windows.append(seed)
    bins = [None] * 256
    for x in windows:
        b = (x >> 56) ^ 128  # bins in the order of signed integers
        if bins[b] is None or x < bins[b]:
            bins[b] = x
    out = list(bins)
    for i in range(256):
        if bins[i] is None:
            start = h(i.to_bytes(4, "little")) & 0xFFFFF
            step = 2 * (start >> 9) + 1
            out[i] = next(bins[(start + step * t) % 256] for t in range(256) if bins[(start + step * t) % 256] is not None)
    return "".join(f"{x & 255:02X}" for x in out)


def test_fingerprint_matches_plain_version(spark):
    rng = random.Random(31)
    texts = [sentence(rng, n) for n in [*range(1, 61), 300, 900]] + ["", None, "é 漢字", "a a a a a a a a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp for r in fingerprints.with_fingerprint(rows).select("doc_id", fingerprints.as_hex(F.col("__fp")).alias("fp")).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


# ---- 4


def plain_rules(rows, limit):
    norm = lambda line: tuple(WORD.findall(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))
    seen = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if norm(line):
                seen.setdefault((s, norm(line)), set()).add(t)
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        five = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        cover = {p for j, x in enumerate(five) if five.count(x) > 1 for p in range(j, j + 5)}
        lines = [x for x in t.split("\n") if norm(x)]
        gone = [x for x in lines if len(seen[s, norm(x)]) > limit]
        left = len(w) - sum(len(norm(x)) for x in gone)
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed, len(gone), left, not failed and 100 * left >= 30 * len(w)))
    return out


def test_rules_match_plain_version(spark, odd, nothing):
    rng = random.Random(4)
    shared = [sentence(rng, 9) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = [sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(0, 6))] + rng.sample(shared, rng.randint(0, 3))
        lines += lines[:1] if i % 5 == 0 else []
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines) + ("  ## x\t|" if i % 7 == 0 else ""), None if i % 9 == 0 else f"h{i % 2}"))
    rows += [(60, None, "h0"), (61, "", "h0")]
    got = quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), max_documents=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_rules(rows, 5))
    assert quality_rules.rules(odd).count() == odd.count()
    assert quality_rules.rules(nothing).count() == 0
    kept = {r.doc_id: r.text for r in quality_rules.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=5).collect()}
    for i, t, s in rows:
        if t and s == "h0":
            here = [x for x in shared if sum(x in (u or "").split("\n") for _, u, v in rows if v == s) > 5]
            assert not set(here) & set(kept[i].split("\n"))


# ---- 5


def test_codes_give_any_position():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 4000):
        ids = rng.choice(np.array([0, 1, 255, 256, 50256, 70000, 2**24, 2**32 - 1], np.uint32), n)
        codes = token_codes.Codes.from_bytes(token_codes.Codes.encode(ids).to_bytes())
        assert (codes.decode() == ids).all()
        if n:
            at = rng.integers(0, n, 300)
            assert (codes.get(at) == ids[at]).all()
    with pytest.raises(IndexError):
        token_codes.Codes.encode(np.array([1])).get([1])


def test_tokens_round_trip(spark, odd, nothing, tmp_path):
    token_codes.write_tokens(odd, f"{tmp_path}/t")
    table = token_codes.read_tokens(spark, f"{tmp_path}/t")
    got = sorted(((r.doc_id is None, r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_codes.document_ids(table).collect())
    tok = Tokenizer.from_file(token_codes.tokenizer_path())
    rows = sorted(((r.doc_id is None, r.doc_id), r.text or "") for r in odd.collect())
    start, every = 0, []
    for (i, t), g in zip(rows, got, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert g == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        every += ids
    at = [0, 1, len(every) // 2, len(every) - 1]
    assert token_codes.token_at(spark, f"{tmp_path}/t", at) == [every[p] for p in at]
    scans = [x for x in token_codes.tokens_at(spark, f"{tmp_path}/t", at)._jdf.queryExecution().simpleString().splitlines() if "FileScan" in x]
    # only the asked segments' codes are scanned; what was searched before is not part of the plan any more
    assert len(scans) == 1 and "codes" in scans[0] and "part#" in scans[0].split("DataFilters")[1] and "seq#" in scans[0].split("DataFilters")[1]
    with pytest.raises(IndexError):
        token_codes.token_at(spark, f"{tmp_path}/t", [len(every)])
    token_codes.write_tokens(nothing, f"{tmp_path}/e")
    assert token_codes.document_ids(token_codes.read_tokens(spark, f"{tmp_path}/e")).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a\n b ", "x  y", "　 a", "it's 'tis", "é è <|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|>b.c", "x.\n\nY, z!\n é\n.", "q'.d", "a\x1c b\x85 c", "12 345 .. ,,", "\t\t a"])
def test_cuts_never_change_ids(text):
    enc = token_codes.Encoder(token_codes.tokenizer_path())
    ids, counts = enc.encode(Texts.of([text, "", text]))
    want = Tokenizer.from_file(token_codes.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]


# ---- 6


def plain_maximal(scores):
    """All maximal scoring segments by their definition: recursive best segments."""
    if not len(scores):
        return []
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1]))
    if best[0] <= 1e-12:
        return []
    _, _, i, j = best
    return [*plain_maximal(scores[:i]), (i, j, best[0]), *[(a + j, b + j, s) for a, b, s in plain_maximal(scores[j:])]]


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, drift = int(rng.integers(1, 25)), -float(rng.uniform(0.05, 2))
        score = np.where(rng.random(n) < 0.35, rng.uniform(0.1, 3, n), 0.0)
        got = toxicity._maximal(score, drift)
        want = plain_maximal(np.where(score > 0, score, drift))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_holds_out(spark, odd, nothing):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        words, toxic = sentence(rng, 80).split(), i % 5 == 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randint(20, 60), rng.choice(["Vile", "awful,", "rotten"]))
        rows.append((i, " ".join(words), int(toxic)))
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 4 == 2
    model = toxicity.fit([r[1] for r in rows if not held(r)], np.array([r[2] for r in rows if not held(r)]))
    test = [r for r in rows if held(r)]
    score = model.score(model.statistics(Texts.of([r[1] for r in test]))[0])
    assert all((s >= 0.3) == bool(r[2]) for s, r in zip(score, test, strict=True))
    found = toxicity.passages(spark.createDataFrame(rows, "doc_id long, text string, y int"), model).collect()
    assert {r.doc_id for r in found} >= {r[0] for r in test if r[2]} and all(r.passage for r in found)
    out = toxicity.score(odd, model, odd.columns).collect()
    assert len(out) == odd.count() and all(0 <= r["__score"] <= 1 for r in out)
    assert toxicity.score(nothing, model, ["doc_id"]).count() == 0
    assert toxicity.fit(["a"], np.array([1])).constant == 1.0


# ---- 7


def test_marginal_sums_all_segmentations():
    table_pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    from sparkloom.llm.lattice import PieceTable

    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.1], [0.1, 0.2], [0.1, 0.1], [0.15, 0.2], [0.05, 0.1]])

    def plain(w, k):
        if not w:
            return 1.0
        total = sum(p[i, k] * plain(w[len(x) :], k) for i, x in enumerate(table_pieces) if w.startswith(x))
        return total + (language_id.UNCOVERED * plain(w[1:], k) if w[0] not in table_pieces else 0)

    words = ["▁abab", "▁bab", "▁c", "▁aab", "▁abcab"]
    got = language_id.log_probabilities(PieceTable(table_pieces), words, p)
    assert np.allclose(got, np.log([[plain(w, k) for k in (0, 1)] for w in words]))


def test_long_runs_are_summed_whole():
    rng = random.Random(7)
    letters = "abcdef"
    vocab = sorted({"▁", *letters, *("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)), "▁ab", "▁fa"})
    table = language_id.PieceTable(vocab)
    p = np.array([[rng.random(), rng.random()] for _ in vocab])
    p /= p.sum(axis=0)
    words = ["▁" + "".join(rng.choice(letters + "z" * (i % 2)) for _ in range(n)) for i, n in enumerate([5, 31, 32, 33, 63, 64, 65, 200, 210, 500, 500])]
    got = language_id.log_probabilities(table, words, p)
    index = {w: i for i, w in enumerate(vocab)}
    for w, row in zip(words, got, strict=True):
        for k in (0, 1):
            logs = [0.0]
            for end in range(1, len(w) + 1):
                ways = [logs[end - n] + math.log(p[index[w[end - n : end]], k]) for n in range(1, min(end, 8) + 1) if w[end - n : end] in index]
                if w[end - 1] not in index:
                    ways.append(logs[end - 1] + math.log(language_id.UNCOVERED))
                top = max(ways)
                logs.append(top + math.log(sum(math.exp(x - top) for x in ways)))
            want = logs[-1]
            assert abs(row[k] - want) < 1e-6 * abs(want)


def test_languages(spark, odd, nothing):
    rng = random.Random(7)
    stock = {"en": ["the", "house", "with", "light", "thing"], "de": ["der", "haus", "mit", "licht", "schön"], "es": ["la", "casa", "con", "luz", "señor"]}
    make = lambda k: " ".join(rng.choice(stock[k]) for _ in range(20))
    langs = [k for k in stock for _ in range(20)]
    model = language_id.fit([make(k) for k in langs], langs, language_id.vocabulary())
    scorer = language_id.Scorer(model)
    pred, score = scorer.predict(Texts.of([make(k) for k in stock] + ["", None, "12 !!", "—"]))
    assert pred == [*stock, "und", "und", "und", "und"] and (score[3:] == 0).all() and (score[:3] > 0.9).all()
    out = language_id.identify(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert language_id.identify(nothing, model).count() == 0
    untaught = language_id.train(nothing)
    assert [r.lang_pred for r in language_id.identify(odd.limit(2), untaught).collect()] == ["und", "und"]


# ---- 8


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_targets(spark, odd, nothing):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randint(0, 30)) or None, rng.choice(["a", "B", "é", None, "big", "big", "big"])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.plan_mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r["__mix_source_size"] == sizes[r.source] and abs(r["__mix_target"] - want[r.source]) < 1e-6 and 0 <= r["__mix_repeats"] <= 2
        taken[r.source] = taken.get(r.source, 0) + r["__mix_size"] * r["__mix_repeats"]
    assert all(abs(taken[s] - want[s]) <= 31 for s in want)
    again = mixing.plan_mix(docs.repartition(2)).select("doc_id", "__mix_repeats").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r["__mix_repeats"]) for r in got)
    assert mixing.mix_rows(docs).count() == sum(r["__mix_repeats"] for r in got)
    assert mixing.mix_rows(odd).columns == odd.columns and mixing.plan_mix(odd).count() == odd.count()
    assert mixing.plan_mix(nothing).count() == 0


def test_mix_of_nameless_and_equal_rows_meets_targets_and_its_sql(spark, tmp_path):
    rng = random.Random(12)
    rows = [(None, sentence(rng, rng.randint(1, 20)), "nameless") for _ in range(500)]
    rows += [(7, "the same five words here", "equal")] * 400 + [(None, "also equal words", "both")] * 300 + [(i, sentence(rng, 9), "both") for i in range(300)]
    rows += [(i % 5, sentence(rng, 12), None) for i in range(200)] + [(3, None, "silent"), (3, "", "silent")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, mixing.op8_mix(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(mixing.OP8_SQL)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(found.fetchall(), key=repr)
    assert [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got] == [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in want]
    taken, target = {}, {}
    for _, size, whole, aim, words in got:
        assert words <= 2 * size
        taken[whole], target[whole] = taken.get(whole, 0) + words, aim
    assert all(abs(taken[k] - target[k]) <= 25 for k in taken)


# ---- 9


def plain_viterbi(coder, word):
    known = {p: (i, s) for p, i, s in zip(coder.table.pieces, coder.ids.tolist(), coder.scores.tolist(), strict=True)}
    best = [(0.0, None)] + [(-np.inf, None)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - coder.table.longest), end):
            w = word[start:end]
            s = known[w][1] if w in known else coder.unknown if end - start == 1 else None
            if s is not None and best[start][0] + s > best[end][0]:
                best[end] = (best[start][0] + s, start)
    out, end = [], len(word)
    while end:
        start = best[end][1]
        w = word[start:end]
        out = ([known[w][0]] if w in known else coder.byte_ids[list(w.encode())].tolist()) + out
        end = start
    return out


def test_viterbi_matches_plain_version(spark, odd, nothing):
    coder = pieces.Pieces(pieces.model_path())
    rng = random.Random(10)
    words = ["▁" + "".join(rng.choice("theandoringstéñ漢\n") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    ids, sizes = coder.segment(words)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, w in enumerate(words):
        assert ids[at[i] : at[i + 1]].tolist() == plain_viterbi(coder, w)
    texts = ["", None, " a  b ", "line\n\ttwo", "a" * 700, "漢字 😀", "x y x y", "   "]
    ids, counts = coder.encode(Texts.of(texts))
    assert [x.decode() for x in coder.decode(ids, counts)] == [t or "" for t in texts]
    out = pieces.encode(odd, odd.columns, ids=True).collect()
    assert len(out) == odd.count() and all(r["__round_trip"] and len(r["__ids"]) == r["__pieces"] for r in out)
    assert pieces.encode(nothing, ["doc_id"]).count() == 0


# ---- 10


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(11)
    left, right = [], []
    for _ in range(200):
        a = [rng.randint(0, 50) for _ in range(rng.randint(0, 90))]
        b = list(a)
        for _ in range(rng.randint(0, 22)):
            at, how = rng.randint(0, len(b)), rng.random()
            b[at : at + (how < 0.6)] = [rng.randint(0, 50)] * (how > 0.3)
        left.append(np.array(a, np.uint32))
        right.append(np.array(b, np.uint32))
    for a, b, s in zip(left, right, order_minhash.similarities(left, right), strict=True):
        longer, d = max(len(a), len(b)), plain_distance(a.tolist(), b.tolist())
        want = (1 - d / longer if longer else 1.0) if d <= int(0.2 * longer + 1e-9) else 0.0
        assert abs(s - want) < 1e-12


def test_occurrences_and_order_matter():
    words = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    swapped = np.concatenate([words[20:], words[:20]])
    doubled = np.concatenate([words, words])
    at = np.array([0, 40, 80, 160])
    h, first = order_minhash.labelled_windows(np.concatenate([words, swapped, doubled]), at)
    assert len(set(h[first[2] : first[3]].tolist())) == first[3] - first[2]
    sk = order_minhash.sketch(np.concatenate([words, words, swapped]), np.array([0, 40, 80, 120]))
    assert (sk[0] == sk[1]).all() and (sk[0] != sk[2]).sum() > order_minhash.SKETCHES // 4


def test_near_duplicates_match_plain_version(spark, odd, nothing):
    rng = random.Random(12)
    base = [sentence(rng, rng.randint(60, 150)).split() for _ in range(25)]
    rows = []
    for i in range(140):
        w = list(base[i % 25])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "solo words"), (203, "solo words")]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = ((t or "").lower().split() for t in (rows[a][1], rows[b][1]))
            longer = max(len(x), len(y))
            close = x == y or (abs(len(x) - len(y)) <= 0.2 * longer and len(set(x) & set(y)) >= 0.7 * len(set(x)) and plain_distance(x, y) <= int(0.2 * longer + 1e-9))
            if close:
                ra, rb = root(rows[a][0]), root(rows[b][0])
                parent[max(ra, rb)] = min(ra, rb)
    assert got == {i: root(i) for i, _ in rows}
    assert order_minhash.near_duplicates(odd).count() == odd.count()
    assert order_minhash.near_duplicates(nothing).count() == 0


def test_quality_learns_from_all_ids_when_lines_run_out(spark, monkeypatch):
    rng = random.Random(25)
    monkeypatch.setattr(quality_crf, "TRAIN_LINES", 250)
    docs = spark.createDataFrame([(i, sentence(rng, 8)) for i in range(700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 350)) for i in range(700)], "doc_id long, quality int")
    assert quality_crf.train(docs, labels).constant is None


def test_null_ids_keep_their_groups(spark):
    rng = random.Random(21)
    base = sentence(rng, 60)
    near, other, lone = base.split(), sentence(rng, 60), sentence(rng, 50)
    near[30] = "changed"
    rows = [(1, base), (None, base), (2, base), (3, " ".join(near)), (None, other), (-7, other.replace(" ", "  ")), (None, lone), (None, lone), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes = order_minhash.near_duplicates(docs).collect()
    assert len(classes) == len(rows) and sum(r.made for r in classes) == 5
    assert {r.class_id for r in classes if r.doc_id in (1, 2, 3)} == {1} and sum(r.class_id == 1 for r in classes) == 4
    out = [(r.doc_id, r.text) for r in order_minhash.stage(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted([(1, base), (-7, other.replace(" ", "  ")), (None, lone), (None, None)], key=str)


def test_links_inside_a_hot_bucket(spark):
    rng = random.Random(22)
    passage, tail = sentence(rng, 40), [f"t{i}" for i in range(20)]
    copies = [[f"u{i}" for i in range(20)] for _ in range(120)]
    for i, w in enumerate(copies):
        w[i % 20] = f"v{i}"
    ends = [(100 + i, w) for i, w in enumerate(copies)]
    ends += [(150_000 + j, [f"{w}x{j}" if i % 4 == j else w for i, w in enumerate(tail)]) for j in range(2)]
    rows = [(i if i < 1000 else i - 149_850, f"{passage} {' '.join(w)}") for i, w in ends if i not in (150, 151)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: 150 if i in (150, 151) else 100 for i, _ in rows}


def test_scattered_edits_are_found(spark):
    rng = random.Random(24)
    rows, want = [], {}
    for i in range(80):
        n = 100 if i < 60 else rng.randint(5, 12)
        a = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        b = list(a)
        for at in rng.sample(range(n), n // 5) if i < 60 else [n // 2]:
            b[at] = f"new{rng.randint(0, 10**6)}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_similar_texts_share_a_leading_pair(spark):
    rng = random.Random(23)
    rows, near = [], []
    for i in range(300):
        a = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(1, 8)):
            at, how = rng.randint(0, len(b)), rng.random()
            b[at : at + (how < 0.6)] = [rng.randint(0, 30)] * (how > 0.3)
        if plain_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
            near.append(i)
        rows += [(2 * i, np.array(a, np.uint32).tobytes()), (2 * i + 1, np.array(b, np.uint32).tobytes())]
    keys = {}
    for r in order_minhash._prefixes(spark.createDataFrame(rows, "node long, words binary"), 0.8).collect():
        keys.setdefault(r.node, set()).add(r.key)
    assert len(near) > 80 and all(keys[2 * i] & keys[2 * i + 1] for i in near if rows[2 * i][1])


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (5, 5), (6, 7)], "a long, b long")
    assert {r.node: r.root for r in order_minhash.components(edges).collect()} == {2: 1, 3: 1, 4: 1, 7: 6, 8: 6, 9: 6}


def test_pieces_encoded_together_have_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_codes, "_JOIN", 40)
    rng = random.Random(9)
    alphabet = [*"abXY  \n\t.,'|<>09é漢😀", " ", "　", " ", "\x85", "\x1c", "<|endoftext|>", " the", " stone", "'s"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    ids, counts = token_codes.Encoder(token_codes.tokenizer_path()).encode(Texts.of(texts))
    want = [e.ids for e in Tokenizer.from_file(token_codes.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
