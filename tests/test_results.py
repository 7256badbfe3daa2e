"""Result views, subwords and labels carried over per annotator."""

import pytest
from pyspark.sql import functions as F

from garimpo.operators import crf, remap, results, subwords
from garimpo.shared import shared_folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_subwords_follow_the_helpers(spark):
    for n in (1, 8, 31, 32, 33, 80):
        got = spark.range(1).select(subwords.windows(F.lit(n), 32, 8).alias("w")).first()["w"]
        assert [tuple(x) for x in got] == crf.windows(n, 32, 8)
    with pytest.raises(ValueError):
        subwords.windows(F.lit(3), 4, 4)
    words = [f"{'x' * (k % 9)}" for k in range(47)]
    counts = subwords.fixed_pieces(4)
    df = spark.createDataFrame([(words,), ([],)], "tokens array<string>")
    for limit in (10, 30, 60, 200):
        kept = crf.fits(lambda w: sum(max(1, -(-len(x) // 4)) for x in w), words, limit, 5)
        assert [r[0] for r in df.select(subwords.kept_words(counts(F.col("tokens")), limit, 5)).collect()] == [len(kept), 0]
    one = spark.createDataFrame([(["abcdefgh", "x"], ["B-DATA", "O"])], "tokens array<string>, labels array<string>")
    c = counts(F.col("tokens"))
    assert one.select(subwords.aligned_labels(F.array(F.lit(3), F.lit(0)), c)).first()[0] == [3, -100, 0]
    assert one.select(subwords.word_labels(F.array(F.lit("B-DATA"), F.lit("I-DATA")), c, F.col("tokens"))).first()[0] == ["B-DATA", "O"]


def test_annotations_are_carried_over_or_kept(spark):
    s = spark.createDataFrame([(1, "h", ["em", "10/10/2020", "ok"]), (2, "h", ["a", "b"]), (3, "h", ["dia", "11/11/2021"]), (4, "h", ["12/12/2022", "x"]), (5, "h", None)], "sentenca_id bigint, extra string, tokens array<string>")
    a = spark.createDataFrame(
        [(1, 7, 0, "O"), (1, 7, 1, "B-DATA"), (1, 7, 2, "O"), (1, 8, 0, "O"), (1, 8, 1, "O"), (1, 8, 2, "B-PESSOA"), (2, 7, 0, "O"), (3, 7, 0, "O"), (4, 7, 0, "B-PESSOA"), (4, 7, 1, "O"), (4, 8, 0, "O"), (4, 8, 1, "O")],
        "sentenca_id bigint, anotador_id bigint, posicao int, label string",
    )
    assert rows(remap.plan_coverage(s, a)) == [(1, 7, True), (1, 8, True), (3, 7, False), (4, 7, True), (4, 8, True)]
    done = remap.remap_annotations(s, a)
    assert dict(rows(done.counters)) == {"transferida": 1, "erro": 1, "revisar": 1, "igual": 2}
    new = {r["sentenca_id"]: r["tokens"] for r in done.sentences.collect()}
    assert new[1] == ["em", "__DATA__", "ok"] and new[4] == ["12/12/2022", "x"] and new[5] is None and done.sentences.columns == s.columns
    got = rows(done.annotations)
    assert (1, 7, 1, "O") in got and (1, 8, 2, "B-PESSOA") in got and (4, 7, 0, "B-PESSOA") in got and len(got) == 12
    over = spark.createDataFrame([(4, ["B-DATA", "O"]), (3, ["O", "O"])], "sentenca_id bigint, labels array<string>")
    again = remap.remap_annotations(s, a, over)
    assert dict(rows(again.counters)) == {"transferida": 2, "erro": 1, "igual": 2} and (4, 8, 0, "B-DATA") in rows(again.annotations)
    lab = spark.createDataFrame([(4, ["q", "12/12/2022", "x"], ["O", "B-PESSOA", "O"])], "sentenca_id bigint, tokens array<string>, labels array<string>")
    assert [tuple(r) for r in remap.review_report(lab, 1).collect()] == [(4, 0, ["q", "12/12/2022", "x"], ["q", "__DATA__", "x"], ["B-PESSOA"])]
    assert remap.remap_annotations(s.where("false"), a.where("false")).counters.count() == 0


def test_a_placeholder_within_a_token_counts():
    assert remap.plan_labels(["x", "10h"], ["x(__HORA__)"], ["O", "B-HORA"]) == (True, "", ["O"])


def test_continued_names(spark):
    g = spark.createDataFrame([(1, 0, "Ana", "B-PESSOA"), (1, 1, "Lima", "O"), (1, 3, "Rui", "O")], "sentenca_id bigint, posicao int, token string, label string")
    fix = spark.createDataFrame([(1, 1, "Lima", "O", "PESSOA"), (1, 3, "Rui", "O", "PESSOA"), (1, 0, "Eva", "O", "DATA")], "sentenca_id bigint, posicao int, token string, label_antigo string, tipo_novo string")
    assert [r[3] for r in rows(remap.relabel_continuing(g, fix).select("sentenca_id", "posicao", "token", "label"))] == ["B-PESSOA", "I-PESSOA", "B-PESSOA"]


def test_results_of_experiments_without_runs(spark):
    tr = spark.createDataFrame([(1, 5, None, "m")], "id bigint, experimento_id bigint, criado_em timestamp, modelo string")
    an = spark.createDataFrame([(9, 5, None, "a", None, 0.5, 0.4, 0.3), (8, 6, None, "a", 0.1, 0.5, 0.4, 0.3)], "id bigint, experimento_id bigint, criado_em timestamp, modelo string, f1_original double, f1_anonimizado double, coverage double, precision_anon double")
    ev = spark.createDataFrame([], "treinamento_id bigint, f1_micro double")
    got = results.for_templates(results.results_table(an, tr, ev)).collect()
    assert len(got) == 1 and got[0]["F1_NER"] is None and got[0]["DeltaF1"] is None and got[0]["lugar"] == 1
    assert results.active(an, None).count() == 2 and results.active(an, 6).count() == 1


def test_local_folder_only_in_local_mode(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

            class getConf:
                get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        shared_folder(Elsewhere())
