"""The corpus pipeline on a small table, and the registered queries."""

import random
from collections import Counter

from test_operators import WORD, sentence

import corpus_pipeline
from sparkloom.llm import queries


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = sentence(rng, 60).split()
        toxic, bad = i % 8 == 1, i % 8 == 2
        if toxic:
            for _ in range(6):
                w.insert(rng.randint(10, 50), rng.choice(["vile", "awful", "rotten"]))
        if bad:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", None))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + i, rows[i * 8][1], "en", "s0", None) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    clean = {i for i in range(400) if i % 8 not in (1, 2)}
    assert ids <= clean and len(ids) > 0.5 * len(clean)
    assert all(r.round_trip and len(r.piece_ids) == r.n_pieces for r in out)
    words = {r[0]: len(WORD.findall(r[1])) for r in rows}
    assert abs(sum(words[r.doc_id] for r in out) - 1.5 * sum(words[i] for i in clean)) < 500


def test_every_operator_has_a_query():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(queries.oracle_sql()) <= set(names)
    assert [f.__module__ for _, f in corpus_pipeline.STAGES]


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, block string"


def odd_tables(spark, tmp_path, empty=False):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        w = sentence(rng, 50).split()
        toxic, bad = i % 8 == 1, i % 8 == 2
        w = [x for y in w for x in ([y, "vile"] if toxic and rng.random() < 0.2 else [y + "%%%"] if bad else [y])]
        rows.append((i, " ".join(w), "en", f"s{i % 2}" if i % 5 else None, None, 0.5, "b"))
        labels.append((i, int(not bad), int(toxic)))
    long = "\n".join(sentence(rng, 12) + "." for _ in range(400))
    rows += [(None, sentence(rng, 40), None, "s0", 1, None, None), (None, sentence(rng, 40), "en", None, 1, None, "x"), (500, None, "en", "s1", None, 0.1, "y"), (501, "", None, None, 0, 0.1, "y")]
    rows += [(502, long, "en", "s0", 9, 0.2, "z"), (503, long, "en", "s1", 9, 0.2, "z"), rows[8], rows[8], (8, sentence(rng, 45), "en", "s0", None, 0.5, "b")]
    docs, marks = spark.createDataFrame(rows, ODD), spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    (docs.limit(0) if empty else docs.repartition(4)).write.parquet(f"{tmp_path}/documents.parquet")
    (marks.limit(0) if empty else marks).write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages_on_odd_rows(spark, tmp_path):
    rows = odd_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bag = lambda frame: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.score, r.block) for r in frame.collect())
    before = Counter(rows)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i == len(corpus_pipeline.STAGES) - 1:
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs, now = spark.read.parquet(f"{tmp_path}/{name}.parquet"), bag(spark.read.parquet(f"{tmp_path}/{name}.parquet"))
        assert set(now) <= set(before)
        if name in ("toxicity", "quality"):
            # a filter takes or leaves a text, and nearly all clean ones stay
            assert all(n == before[r] for r, n in now.items())
            clean = [r for r in before if r[0] is not None and r[0] < 240 and r[0] % 8 not in (1, 2)]
            assert sum(r in now for r in clean) > 0.9 * len(clean)
        if name == "near_dedup":
            ids = [r[0] for r in now if r[0] is not None]
            assert len(ids) == len(set(ids)) and not {502, 503} <= set(ids) and max(now.values()) == 1
            # what is gone has a near copy of lesser id, an equal id, or no words like another
            assert sum(r[0] is not None and r[0] < 240 and r[0] != 8 for r in now) >= len({r[0] for r in before if r[0] is not None and r[0] < 240 and r[0] != 8})
        if name == "mix":
            assert all(n <= 2 * before[r] for r, n in now.items())
        before = now
    rows_out = out.collect()
    assert Counter(r.doc_id for r in rows_out) == Counter(k for r, n in before.items() for k in [r[0]] * n)
    assert all(len(r.piece_ids) == r.n_pieces for r in rows_out)


def test_pipeline_of_nothing(spark, tmp_path):
    odd_tables(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
