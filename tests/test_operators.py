"""Small cases of the core operators."""

import hashlib
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.operators import anonymize, audit, crf, labels, metrics, profile, remap, sampling, spans
from garimpo.plans import catalog
from garimpo.ranking import permuted_rank
from garimpo.sources import files, rawload


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def gold(spark):
    data = [(1, i, t, x) for i, (t, x) in enumerate(zip(["x", "Ana", "Lima", "y", "z"], ["O", "B-PESSOA", "I-PESSOA", "I-DATA", "O"]))]
    return spark.createDataFrame(data, "sentenca_id bigint, posicao int, token string, label string")


def test_span_modes(gold):
    assert rows(spans.bio_spans(gold, "strict")) == [(1, 1, 3, "PESSOA", "Ana Lima")]
    assert rows(spans.bio_spans(gold, "seqeval")) == [(1, 1, 3, "PESSOA", "Ana Lima"), (1, 3, 4, "DATA", "y")]
    assert rows(spans.bio_spans(gold, "run")) == [(1, 1, 4, "DATA", "Ana Lima y")]
    assert rows(spans.bio_spans(gold, "typed-run", "DATA")) == [(1, 3, 4, "DATA", "y")]
    with pytest.raises(ValueError):
        spans.bio_spans(gold, "none")


def test_markers(spark, gold):
    s = spans.numbered(spans.bio_spans(gold))
    t = spark.createDataFrame([(1, ["x", "Ana", "Lima", "y", "z"]), (2, ["so"])], "sentenca_id bigint, tokens array<string>")
    assert rows(spans.replace_spans(t, s)) == [(1, "x [PESSOA_1] y z"), (2, "so")]


def test_kappa_bounds(spark):
    same = spark.createDataFrame([("O", "O"), ("B-X", "B-X")], "a1 string, a2 string")
    assert labels.kappa(same).first()["kappa"] == 1.0
    flat = spark.createDataFrame([("O", "O")] * 3, "a1 string, a2 string")
    assert labels.kappa(flat).first()["kappa"] == 1.0
    empty = labels.kappa(same.where("false")).collect()
    assert not empty or empty[0]["kappa"] is None


def test_audit_and_relabel(spark, gold):
    assert rows(audit.orphan_inside(gold)) == [(1, 3, "y", "I-DATA", "I-PESSOA")]
    fix = spark.createDataFrame([(1, "y", "I-DATA", "B-DATA"), (1, "y", "O", "B-DATA")], "sentenca_id bigint, token string, label_antigo string, label_novo string")
    assert remap.relabel(gold, fix).where("token = 'y'").first()["label"] == "B-DATA"
    assert remap.not_applied(gold, fix).count() == 1


def test_remap_rules():
    assert remap.plan_labels(["a", "b"], ["a", "b"], ["O", "B-X"]) == (True, "", ["O", "B-X"])
    assert remap.plan_labels(["em", "10:30"], ["em", "__HORA__"], ["O", "B-HORA"]) == (True, "", ["O", "O"])
    assert remap.plan_labels(["Ana.Lima"], ["Ana", ".", "Lima"], ["B-PESSOA"])[0] is False
    assert remap.plan_labels(["Ana.Lima"], ["Ana", ".", "Lima"], ["B-PESSOA"], {(("Ana.Lima",), ("Ana", ".", "Lima")): ["B-PESSOA", "O", "I-PESSOA"]})[0]


def test_indel(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(metrics.indel_distance("a", "b")).collect()] == [0.3333, 0.0, None]


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([(0,), (0,), (10,)], "v int")
    h = profile.histogram(df, F.col("v"), 5).orderBy("faixa").collect()
    assert [r["textos"] for r in h] == [2, 0, 0, 0, 1]


def test_permuted_rank_is_dense(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "a").otherwise("b"))
    got = permuted_rank(df, ["g"], F.xxhash64("id"), "r", buckets=8)
    assert got.count() == 1000
    for g, n in (("a", 900), ("b", 100)):
        assert [r[0] for r in got.where(F.col("g") == g).select("r").orderBy("r").collect()] == list(range(1, n + 1))


def test_reserved_split(spark):
    random.seed(1)
    data = [(i, [t for t in ("PESSOA", "DATA") if random.random() < 0.1]) for i in range(200)]
    df = spark.createDataFrame(data, "sentenca_id bigint, tipos array<string>")
    got = sampling.reserved_split(df, ["PESSOA", "DATA"])
    assert got.count() == got.select("sentenca_id").distinct().count() == 200
    assert set(map(tuple, got.collect())) == set(map(tuple, sampling.reserved_split(df, ["PESSOA", "DATA"]).collect()))
    assert sampling.split_check(df, got).where("dev = 0 or teste = 0").count() == 0


def test_reserved_split_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    data = [(i, [t for t in ("PESSOA", "DATA", "XYZ") if (i * 7919) % k == 0] or None) for i in range(200) for k in [3 + i % 5]]
    df = spark.createDataFrame(data, "sentenca_id bigint, tipos array<string>").mapInArrow(passed, "sentenca_id bigint, tipos array<string>")
    got = dict(map(tuple, sampling.reserved_split(df, ["PESSOA", "DATA"], least=2).collect()))
    assert seen.value == 200 and len(got) == 200
    h = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    want = {}
    for t in ("PESSOA", "DATA"):
        for k, i in enumerate([i for i in sorted(range(200), key=h) if t in (data[i][1] or []) and i not in want][:4]):
            want[i] = "dev" if k < 2 else "teste"
    rest = [i for i in sorted(range(200), key=h) if i not in want]
    each = round(0.15 * len(rest)) - 4
    want |= {i: "dev" if k < each else "teste" if k < 2 * each else "treino" for k, i in enumerate(rest)}
    assert got == want


def test_gold_types(spark):
    random.seed(3)
    names = ["O", "O", "B-PESSOA", "I-PESSOA", "b-data", "B-HORA", "zzz", None]
    n = [random.choice([None, 0, 1, 2, 3]) for _ in range(120)]
    sentences = spark.createDataFrame([(i, 1, None if k is None else ["x"] * k) for i, k in enumerate(n)] + [(5, 1, ["x"] * 6)], "sentenca_id bigint, sessao_id bigint, tokens array<string>")
    given = [(random.randrange(-1, 125), random.choice([None, 1, 2, 3]), random.randrange(-1, 5), random.choice(names), random.choice([None, *range(3)])) for _ in range(900)]
    annotations = spark.createDataFrame(given, "sentenca_id bigint, anotador_id bigint, posicao int, label string, s int").withColumn("atualizado_em", F.timestamp_seconds("s")).drop("s")
    chosen = [(random.randrange(0, 125), random.choice([None, 0, 1, 2, 7]), random.choice([*names, "X"]), s) for s in range(150)]
    decided = labels.adjudications(spark.createDataFrame(chosen, "sentenca_id bigint, posicao int, label string, s int").withColumn("criado_em", F.timestamp_seconds("s")))
    gold = labels.gold(labels.token_grid(sentences, annotations), decided)
    want = gold.groupBy("sentenca_id").agg(F.array_sort(F.collect_set(F.when(F.col("label") != "O", F.substring("label", 3, 100)))).alias("tipos"))
    got = rows(labels.gold_types(sentences, annotations, decided))
    assert got == rows(want) and len(got) > 50 and sum(len(t) > 1 for _, t in got) > 5


_SMALL = """
from pyspark.sql import SparkSession, functions as F
from garimpo.operators import labels
spark = SparkSession.builder.master("local[8]").config(map={"spark.driver.memory": "480m", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}).getOrCreate()
n = 20_000
sentences = spark.range(n).select(F.col("id").alias("sentenca_id"), F.array_repeat(F.lit("x"), 100).alias("tokens"))
label = F.when(F.col("id") % 10 == 0, "B-PESSOA").otherwise("O")
annotations = spark.range(n * 200).select((F.col("id") % n).alias("sentenca_id"), (F.col("id") % (2 * n) >= n).cast("bigint").alias("anotador_id"), F.floor(F.col("id") / (2 * n)).cast("int").alias("posicao"), label.alias("label"), F.timestamp_seconds(F.lit(1)).alias("atualizado_em"))
decisions = spark.createDataFrame([(10, 0, "O")], "sentenca_id bigint, posicao int, label string")
print("types", labels.gold_types(sentences, annotations, decisions).groupBy(F.array_join("tipos", " ").alias("t")).count().orderBy("t").collect())
"""


def test_gold_types_in_little_memory():
    """Four million annotations in a heap that cannot hold their keys."""
    run = subprocess.run([sys.executable, "-c", _SMALL], env={k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"PYTHONPATH": str(Path(labels.__file__).parents[2])}, capture_output=True, text=True, timeout=600)
    assert "types [Row(t='', count=18000), Row(t='PESSOA', count=2000)]" in run.stdout, run.stderr[-2000:]


def test_split_check_reads_annotations_once(spark, tmp_path):
    spark.createDataFrame([(i, 1, ["a", "b"]) for i in range(60)], "sentenca_id bigint, sessao_id bigint, tokens array<string>").write.parquet(f"{tmp_path}/sentenca.parquet")
    t = F.timestamp_seconds(F.lit(1))
    given = spark.createDataFrame([(i, a, p, "B-PESSOA" if i % 3 == p else "O") for i in range(60) for a in (1, 2) for p in (0, 1)], "sentenca_id bigint, anotador_id bigint, posicao int, label string")
    given.withColumn("atualizado_em", t).write.parquet(f"{tmp_path}/anotacao_token.parquet")
    spark.createDataFrame([(2, 1, "B-HORA")], "sentenca_id bigint, posicao int, label string").withColumn("criado_em", t).write.parquet(f"{tmp_path}/adjudicacao_token.parquet")
    got = catalog.QUERIES["q_split_check"](spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if str(tmp_path) in f]
    assert {r["tipo"]: r["treino"] + r["dev"] + r["teste"] for r in got.collect()} == {"PESSOA": 40, "HORA": 1}


def test_anonymise(spark):
    df = spark.createDataFrame([("Ana ligou (27) 99999-9999",)], "texto string")
    anonymize.register_tagger("ana", lambda t: ["B-PESSOA" if x == "Ana" else "B-HORA" if x == "ligou" else "O" for x in t])
    plain = anonymize.anonymise(df).first()
    tagged = anonymize.anonymise(df, tagger="ana").first()
    assert plain["texto_anonimizado"] == "Ana ligou [CONTATO]" and plain["n_phi_total"] == 1
    assert tagged["texto_anonimizado"] == "[PESSOA] ligou [CONTATO]" and tagged["n_phi_total"] == 2


def test_crf_learns():
    data = [(["sr", "Ana", "veio"], ["O", "B-P", "O"]), (["sr", "Rui", "saiu"], ["O", "B-P", "O"]), (["dor", "leve"], ["O", "O"])] * 5
    model = crf.fit_crf(data, epochs=10)
    assert model.tag(["sr", "Eva", "veio"]) == ["O", "B-P", "O"] and model.tag([]) == []
    assert model.losses[-1] < model.losses[0] and len(model.top_moves()) and len(model.top_features())


def test_subwords():
    assert crf.align_labels([None, 0, 0, 1, None], [5, 7]) == [-100, 5, -100, 7, -100]
    assert crf.windows(10, 6, 2) == [(0, 6), (4, 10)] and crf.windows(3, 6, 2) == [(0, 3)]
    assert len(crf.fits(len, ["w"] * 50, 15)) == 10


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "parecer", ["a", "b"], ["O", "B-X"])], files.SENTENCE)
    files.write_conll(df, f"{tmp_path}/c")
    assert rows(files.read_conll(spark, f"{tmp_path}/c")) == [(["a", "b"], ["O", "B-X"])]
    files.write_sentences(df, f"{tmp_path}/j")
    assert rows(files.read_sentences(spark, f"{tmp_path}/j")) == rows(df)
    (tmp_path / "n.csv").write_text('A;B\n1;"x;\ny"\n2\n3;4;5\nNA;z\n')
    assert rows(files.read_notes(spark, f"{tmp_path}/n.csv", ["A", "B"])) == sorted([("1", "x;\ny"), ("2", None), (None, "z")], key=repr)
    (tmp_path / "t.jsonl").write_text('{"texto": "olá"}\nnão\n{"tokens": ["a", "b"]}\n')
    assert rows(files.read_texts(spark, f"{tmp_path}/t.jsonl")) == [("a b",), ("olá",)]
    (tmp_path / "l.conll").write_text("a\tO\nruim\n \nb\tB-X\n")
    assert rows(files.read_conll(spark, f"{tmp_path}/l.conll", lenient=True)) == [(["a"], ["O"]), (["b"], ["B-X"])]
    assert len(files.list_files(spark, [str(tmp_path), f"{tmp_path}/none"], ".csv")) == 1
    files.small_csv(df.select("doc_id"), f"{tmp_path}/r.csv")
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_import_spans(spark):
    df = spark.createDataFrame([("Sr Ana Lima veio", [["3", "11", "PESSOA"], ["3", "6", "DATA"]])], "text string, label array<array<string>>")
    assert files.import_spans(df).first()["labels"] == ["O", "B-DATA", "I-PESSOA", "O"]


def test_report_parser(spark):
    df = spark.createDataFrame([("      PESSOA  0.90 0.80 0.85 10",), ("cabecalho",), ("  micro avg 0.9 0.8 0.85 10",)], "value string")
    assert [r["label"] for r in metrics.parse_report(df).collect()] == ["PESSOA", "micro avg"]


def split_plainly(line):
    """Field by field reading of one record: the rule the index must agree with."""
    fields, i = 0, 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return -1
                if line[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            if j + 1 < len(line) and line[j + 1] != ";":
                return -1
            i = j + 1
        else:
            j = line.find(";", i)
            i = len(line) if j < 0 else j
        fields += 1
        if i >= len(line):
            return fields
        i += 1


def test_structural_index():
    random.seed(3)
    lines = ["".join(random.choice('a";" \né') for _ in range(random.randint(0, 16))) for _ in range(4000)]
    parts = [x.encode() for x in lines]
    sizes = np.array([len(p) for p in parts])
    start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    count, _, _ = rawload.index_records(np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8), start, start + sizes)
    assert count.tolist() == [split_plainly(x) for x in lines]


def test_raw_records(spark):
    good = "12;01/02/2020;nota;;"
    lines = [good, '12;01/02/2020 10:30;"a ""b""; c";x;y', "", None, '1;"x;2020-01-01 00:00:00;a;b', "0;01/02/2020;a;b;c", "1;31/02/2020;a;b;c", "1;01/02/2009;a;b;c", "1;1;1;1;1;1", good]
    df = spark.createDataFrame([(i, "prescricoes.csv", x, 0) for i, x in enumerate(lines)], "linha_id bigint, arquivo string, linha string, motivo int")
    got = {r["linha_id"]: r["motivo"] for r in rawload.parse_records(df).collect()}
    assert got == {0: None, 1: None, 2: "colunas", 3: "colunas", 4: "aspas", 5: "valor", 6: "valor", 7: "valor", 8: "colunas", 9: None}
    text = {r["linha_id"]: r["ds_evolucao"] for r in rawload.valid_records(df, "prescricoes.csv").collect()}
    assert text[1] == 'a "b"; c' and len(text) == 3
    assert rawload.parse_records(df.where("false")).count() == 0
    long = spark.createDataFrame([(1, "pareceres.csv", "5;01/02/2020;" + "x" * 2_000_000 + ";;")], "linha_id bigint, arquivo string, linha string")
    assert rawload.valid_records(long, "pareceres.csv").select(F.length("ds_parecer")).first()[0] == 2_000_000


def test_stream(spark, tmp_path):
    from garimpo.streaming.annotations import current_labels, read_current

    schema = "sentenca_id bigint, anotador_id bigint, posicao int, label string, criado_em timestamp, atualizado_em timestamp"
    df = spark.sql("select 1L sentenca_id, 1L anotador_id, 0 posicao, x label, timestamp'2024-01-01' criado_em, t atualizado_em from values ('O', timestamp'2024-01-02'), ('B-X', timestamp'2024-01-03') as v(x, t)")
    df.write.parquet(f"{tmp_path}/in")
    current_labels(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r["label"] for r in read_current(spark, f"{tmp_path}/out").collect()] == ["B-X"]


def test_entry_points_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_crf_saved(spark, tmp_path):
    model = crf.fit_crf([(["sr", "Ana"], ["O", "B-P"]), (["dor"], ["O"])] * 4, epochs=5)
    crf.save(model, spark, f"{tmp_path}/crf")
    assert crf.load(spark, f"{tmp_path}/crf").tag(["sr", "Eva"]) == model.tag(["sr", "Eva"])


def test_store(spark, tmp_path):
    from garimpo.sources import store

    schema = "id int, nome string"
    for rows_, gone in (([(1, "a"), (2, "b")], False), ([(1, "c")], False), ([(2, None)], True)):
        store.append(spark.createDataFrame(rows_, schema), f"{tmp_path}/t", gone)
    assert rows(store.current(spark, f"{tmp_path}/t", ["id"])) == [(1, "c")]
    store.compact(spark, f"{tmp_path}/t", ["id"], f"{tmp_path}/u")
    assert rows(store.current(spark, f"{tmp_path}/u", ["id"])) == [(1, "c")]


def test_pipelines(spark, tmp_path):
    from garimpo.plans import pipelines

    d = "/root/testdata/sf0.001"
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    totals = pipelines.preprocess(t("prescricoes"), t("pareceres"), f"{tmp_path}/c", per_type=30, sample_to=40)
    assert {r["doc_type"] for r in totals.collect()} == {"prescricao", "parecer"}
    assert files.read_sentences(spark, f"{tmp_path}/c/amostra.jsonl").count() >= 40
    gold = pipelines.gold_sentences(t("sentenca"), t("anotacao_token"), t("adjudicacao_token"))
    parts, check = pipelines.split(gold, f"{tmp_path}/s")
    assert parts.count() == gold.count() and files.read_conll(spark, f"{tmp_path}/s/train.conll").count() == parts.where("particao = 'treino'").count()
    _, facts, scores = pipelines.train_and_evaluate(parts, epochs=3)
    assert facts["iteracoes"] <= 3 and scores["tokens"].first()["f1_weighted"] > 0.5
    texts = spark.createDataFrame([("CPF 123.456.789-00 ok",)], "texto string")
    assert rows(pipelines.anonymise_corpus(texts, f"{tmp_path}/a")) == [("[DOCUMENTO]", 1)]
    assert len(pipelines.explore(t("prescricoes"), t("pareceres"))) == 11
    g = labels.gold(labels.token_grid(t("sentenca"), t("anotacao_token")), labels.adjudications(t("adjudicacao_token")))
    assert all(x.count() >= 0 for x in pipelines.audit_all(g, t("sentenca")).values())


def test_iso_dates():
    from garimpo.functions.text import iso_dates

    cases = {"01/02/2020": "2020-02-01", "13 / 07 / 22": "2022-07-13", "07/13/2022": "2022-07-13", "17 - 05 - 17": "2017-05-17", "24.10.2016": "2016-10-24", "17 DE MAIO DE 2016": "2016-05-17"}
    cases |= {x: x for x in ("2020-02-01", "120 - 80 - 70", "21.9.7390.1882", "36.5")}
    assert {k: iso_dates(k) for k in cases} == cases


def test_crf_query_fits_on_the_whole_sample(spark, monkeypatch):
    from garimpo.plans import catalog

    d, seen = "/root/testdata/sf0.01", {}

    def fit(sentences, epochs=12, **more):
        seen.update(n=len(sentences), epochs=epochs)
        return crf.Crf({}, ["O"], np.zeros((0, 1)), np.zeros((1, 1)), [])

    monkeypatch.setattr(crf, "fit_crf", fit)
    catalog.QUERIES["q_crf_predict"](spark, d)
    annotated = catalog._labelled_sentences(spark, d).count()
    assert 400 < annotated < crf.SENTENCES and seen == {"n": annotated, "epochs": 12}


def test_crf_sample_is_the_first_by_hash(spark):
    df = spark.range(3000).select(F.col("id").alias("sentenca_id"), F.array(F.col("id").cast("string")).alias("tokens"), F.array(F.lit("O")).alias("labels"))
    wanted = [r[0] for r in df.orderBy(F.md5(F.concat(F.lit("42|"), F.col("sentenca_id").cast("string")))).limit(400).select("tokens").collect()]
    assert [t for t, _ in crf.training_sample(df, 400)] == wanted
    assert len(crf.training_sample(df, 5000)) == 3000 and crf.training_sample(df.where("false")) == []
