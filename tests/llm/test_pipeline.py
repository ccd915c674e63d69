import hashlib
import os

import pyarrow as pa
from test_line_dedup import brute as plain_lines
from test_ngram_join import brute as plain_components
from test_packing import plain_pack

import __spark_entry__ as E
import corpus_pipeline as CP
from tessera.llm import language_id, ngram_join, packing, toxicity
from tessera.llm.common import Words, written


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in CP.STAGES] == ["language_id", "toxicity", "line_dedup", "ngram_join", "packing"]
    seen = [docs]
    for name, stage in CP.STAGES[:-1]:
        out = written(stage(spark, seen[-1], sf_dir), name)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen.append(out)
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    lang = {r["doc_id"] for r in language_id.query(seen[0]).where("lang_pred <> 'und'").where(f"score >= {language_id.REJECT}").collect()}
    assert ids[1] == lang and len(lang) > 0.99 * len(ids[0])
    m = toxicity.learn(seen[1], spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language_id.fold_of(4)))
    assert ids[2] == {r["doc_id"] for r in toxicity.predict(seen[1], m).where("predicted = 0").collect()}
    assert ids[3] == ids[2]
    assert ids[4] == {r["component_id"] for r in ngram_join.near_duplicates(seen[3]).collect()}
    packed = CP.STAGES[-1][1](spark, seen[4], sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == ids[4]
    assert packing.query(seen[4]).count() == packed.count()


def test_registered(spark, sf_dir):
    names = set(E.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert os.path.exists(f"{sf_dir}/documents.parquet")


def test_the_whole_pipeline_equals_a_plain_reading(spark, sf_dir):
    """Every stage again without Spark, but for the fits of the two models, each on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language_id.learn(docs.where(~language_id.fold_of(4)))
    found = {i: language_id.label(model, r["text"]) for i, r in rows.items()}
    left = {i for i, (lang, p) in found.items() if lang != language_id.UNKNOWN and p >= language_id.REJECT}

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language_id.fold_of(4))
    model = toxicity.learn(docs.where(docs["doc_id"].isin(sorted(left))), labels)

    def toxic(text):
        w = Words(pa.array([text]), lower=True)
        return model.probability(*model.evidence(model.found(w)[0], len(w.start))) >= toxicity.THRESHOLD

    left = {i for i in left if not toxic(rows[i]["text"])}
    texts = dict(plain_lines([(i, rows[i]["source"], rows[i]["text"]) for i in left]))
    texts = {i: texts[str(i)] for i in left}
    comp = plain_components(sorted(texts.items()))
    left = {i for i in left if comp[i][1] == i}
    words = {i: [*(texts[i] or "").encode().split(), b""] for i in left}
    top = packing.LENGTHS[-1]
    pieces = sorted(((min(top, len(w) - k * top), i, k) for i, w in words.items() for k in range((len(w) - 1) // top + 1)), key=lambda x: (-x[0], x[1], x[2]))
    where, length = plain_pack([n for n, _, _ in pieces], packing.LENGTHS, packing.bin_cost)
    bins, start = {}, {}
    for (n, i, k), b in zip(pieces, where, strict=True):
        start[i, k] = len(bins.setdefault(b, []))
        bins[b] += words[i][k * top : k * top + n]
    digest = {b: hashlib.sha256(b" ".join(w)).hexdigest() for b, w in bins.items()}
    want = {(i, k, 0, b, length[b], start[i, k], n, digest[b]) for (n, i, k), b in zip(pieces, where, strict=True)}
    got = CP.run(spark, sf_dir).select("doc_id", "piece", "shard", "bin", "length", "start", "n_tokens", "sequence_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_clashing_columns(spark, sf_dir):
    names = ["_maybe", "score", "_id", "n_lines", "n_dropped", "_c0", "c0", "_bad", "_kept", "_host", "salt", "lang_pred", "predicted", "comp", "n"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).selectExpr("*", *(f"concat('{c}', doc_id) `{c}`" for c in names))
    for _, stage in CP.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in names)).count() == 0
    assert CP.STAGES[-1][1](spark, docs, sf_dir).count() >= 40


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, path, rows, marks):
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_null_repeated_and_very_long_rows(spark, tmp_path):
    kind = ["the cat and the dog of the house went to the garden number %d", "le chat et le chien de la maison vont dans le jardin numero %d"]
    rows = [(i, kind[i % 2] % (i * 7919) + "\n" + " ".join(f"{'en' if i % 2 == 0 else 'fr'}{i}x{k}" for k in range(30)), "enfr"[i % 2 * 2 : i % 2 * 2 + 2], f"h{i % 3}") for i in range(80)]
    rows += [(200, None, "en", "h1"), (201, "", None, None), (202, "12 34 ...", "en", "h1"), (None, kind[0] % 5, "en", "h1"), (203, kind[0] % 9 + " the dog" * 60_000, None, "h2"), (204, rows[0][1], "en", "h0"), (205, rows[0][1], "en", "h0"), (7, rows[7][1], "fr", "h1")]
    marks = [(i, 1, 0) for i in range(80)] + [(7, 1, 0), (None, 1, 1), (3, None, None)]
    where = table(spark, tmp_path / "t", rows, marks)
    out = CP.run(spark, where).collect()
    ids = [r["doc_id"] for r in out]
    assert {r["doc_id"] for r in out} == {None, 203, *range(80)}  # no letter: 200 to 202; copies of 0: 204, 205
    assert ids.count(7) == 2 and sum(r["n_tokens"] for r in out if r["doc_id"] == 203) == 2 * 60_000 + 14 + 1


def test_empty_tables_and_no_labels(spark, tmp_path):
    assert CP.run(spark, table(spark, tmp_path / "a", [], [])).collect() == []
    rows = [(i, f"the cat and dog of house {i} " + " ".join(f"w{i}x{k}" for k in range(20)), "en", "h") for i in range(12)]
    assert {r["doc_id"] for r in CP.run(spark, table(spark, tmp_path / "b", rows, [])).collect()} == set(range(12))
