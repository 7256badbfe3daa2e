"""Queries of files, result views and subwords, and the SQL that checks them.

Queries of files write the tables in a format of the workflow and give what its reader
makes of them; the SQL works on the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import patterns as P
from garimpo.operators import audit, metrics, remap, results, sampling, subwords
from garimpo.operators.labels import LABELS
from garimpo.plans import catalog as C
from garimpo.plans import pipelines
from garimpo.plans import sqltext as S
from garimpo.session import table
from garimpo.shared import scratch
from garimpo.sources import files, rawload, store

query = C.query

# -- files ------------------------------------------------------------------------------

_COLUMNS = ["cd_paciente", "dt_atendimento", "{text}", "ds_especialid_atendimento", "ds_multi_empresa"]


def _csv(name: str, text: str) -> None:
    cols = [c.format(text=text) for c in _COLUMNS]
    sql = f"SELECT {', '.join(f'CASE WHEN {c} NOT IN ({C._MISSING}) THEN {c} END AS {c}' for c in cols)} FROM {name}"

    @query(sql, f"q_csv_{name}")
    def run(spark, d):
        path = scratch(spark, "csv")
        files.write_notes(table(spark, d, name).select(cols), path)
        return files.read_notes(spark, path, [c.upper() for c in cols])


_csv("prescricoes", "ds_evolucao")
_csv("pareceres", "ds_parecer")

_LABELLED = f"{S.GOLD}, lab AS (SELECT sentenca_id, list(token ORDER BY posicao) AS tokens, list(label ORDER BY posicao) AS labels FROM gold GROUP BY 1)"


def _gold_docs(spark, d) -> DataFrame:
    return C._labelled_sentences(spark, d).join(table(spark, d, "sentenca").select("sentenca_id", "doc_id", "doc_type"), "sentenca_id")


@query(f"WITH {_LABELLED} SELECT doc_id, doc_type, lab.tokens, labels FROM lab JOIN sentenca USING (sentenca_id)")
def q_jsonl_sentences(spark, d):
    path = scratch(spark, "jsonl")
    files.write_sentences(_gold_docs(spark, d), path)
    return files.read_sentences(spark, path)


@query("SELECT CASE WHEN sentenca_id % 2 = 0 THEN array_to_string(tokens, ' ') ELSE doc_type END AS texto FROM sentenca WHERE tokens IS NOT NULL".replace("ELSE doc_type END", "ELSE coalesce(doc_type, array_to_string(tokens, ' ')) END"))
def q_jsonl_texts(spark, d):
    path = scratch(spark, "texts")
    s = table(spark, d, "sentenca").where("tokens is not null")
    s.select(F.when(F.col("sentenca_id") % 2 == 1, F.col("doc_type")).alias("texto"), "tokens").write.json(path)
    return files.read_texts(spark, path)


@query(f"WITH {_LABELLED} SELECT tokens, labels FROM lab")
def q_conll_strict(spark, d):
    path = scratch(spark, "conll")
    files.write_conll(C._labelled_sentences(spark, d), path)
    return files.read_conll(spark, path)


@query(f"WITH {_LABELLED} SELECT tokens, labels FROM lab")
def q_conll_lenient(spark, d):
    """A file with a line that has no tab before every sentence and blanks at the ends of labels."""
    path = scratch(spark, "lenient")
    lines = files.conll_lines(C._labelled_sentences(spark, d))
    lines.select(F.concat(F.lit("sem rotulo\n"), F.regexp_replace("value", "\n", "  \n"), F.lit(" \t")).alias("value")).write.text(path, lineSep="\n\n")
    return files.read_conll(spark, path, lenient=True)


@query("SELECT tokens, list_transform(tokens, lambda t: 'O') AS labels FROM sentenca WHERE len(tokens) > 0")
def q_conll_unlabelled(spark, d):
    path = scratch(spark, "plain")
    files.write_conll(table(spark, d, "sentenca").where("size(tokens) > 0").select("tokens"), path)
    return files.read_conll(spark, path)


@query(f"WITH {_LABELLED} SELECT particao, lab.tokens, labels FROM lab JOIN divisao USING (sentenca_id) WHERE particao IN ('treino', 'dev', 'teste')")
def q_split_files(spark, d):
    path = scratch(spark, "splits")
    parts = C._labelled_sentences(spark, d).join(table(spark, d, "divisao"), "sentenca_id")
    files.write_splits(parts, path)
    each = [files.read_conll(spark, f"{path}/{f}.conll").withColumn("particao", F.lit(p)) for f, p in (("train", "treino"), ("dev", "dev"), ("test", "teste"))]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("particao", "tokens", "labels")


@query(C.ORACLE_SQL["q_anonymize_regex"].replace("SELECT nr_registro, array_to_string(w, ' ') AS texto_anonimizado, n::INT AS n_phi_regex", "SELECT array_to_string(w, ' ') AS texto_anonimizado, n AS n_phi_regex, 0::BIGINT AS n_phi_ner"))
def q_anonymised_file(spark, d):
    path = scratch(spark, "anon")
    done = C.q_anonymize_regex(spark, d).withColumns({"texto_original": F.lit("x"), "n_phi_ner": F.lit(0)})
    files.write_anonymised(done, path)
    return spark.read.schema("texto_anonimizado string, n_phi_regex bigint, n_phi_ner bigint").json(path)


@query(f"WITH p AS ({C._BY_TYPE}), u AS ({C.ORACLE_SQL['q_entity_f1']}) SELECT 'anotador' AS modelo, u.f1 AS f1_micro, tipo, p.precision, p.recall, p.f1, p.support FROM p, u")
def q_metrics_files(spark, d):
    path = scratch(spark, "metrics")
    both = metrics.compared_spans(C._grid(spark, d), "seqeval")
    micro = metrics.entity_scores(*both).select(F.lit("anotador").alias("modelo"), F.col("f1").alias("f1_micro"))
    files.write_metrics(metrics.entity_scores(*both, by_type=True).crossJoin(F.broadcast(micro)), path)  # one row
    return files.read_metrics(spark, path, multiline=False)


@query(f"WITH p AS ({C._BY_TYPE}) SELECT tipo, " + ", ".join(f"printf('%.4f', {c}) AS {c}" for c in ("precision", "recall", "f1")) + " FROM p")
def q_metrics_csv(spark, d):
    path = scratch(spark, "report").removeprefix("file://") + ".csv"  # the driver writes it: the shared folder must be one of its file system
    files.small_csv(files.consolidated(C.q_entity_f1_by_type(spark, d), "tipo"), path)
    return spark.read.csv(f"file://{path}", sep=";", header=True, schema="tipo string, precision string, recall string, f1 string")


@query(f"WITH {S.COUNTS} SELECT doc_type, count(*) AS textos, min(tok)::BIGINT AS menor, max(tok)::BIGINT AS maior FROM c GROUP BY 1")
def q_stats_json(spark, d):
    """Nested statistics as one JSON text, and what reading it gives."""
    n = C._notes(spark, d).select("doc_type", F.size(C.T.blank_tokens(F.col("texto"))).alias("t"))
    by = n.groupBy("doc_type").agg(F.count(F.lit(1)).alias("textos"), F.struct(F.min("t").alias("menor"), F.max("t").alias("maior")).alias("tokens"))
    text = by.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("doc_type", F.struct("textos", "tokens"))))).alias("json"))  # two rows
    back = text.select(F.explode(F.from_json("json", "map<string,struct<textos:bigint,tokens:struct<menor:bigint,maior:bigint>>>")).alias("doc_type", "s"))
    return back.select("doc_type", "s.textos", "s.tokens.menor", "s.tokens.maior")


@query("SELECT sentenca_id, CASE WHEN sentenca_id % 5 = 0 THEN 'novo' ELSE doc_type END AS doc_type FROM sentenca WHERE sentenca_id % 7 <> 0")
def q_store_current(spark, d):
    """Rows inserted, some updated, some deleted: what the store holds then."""
    path = scratch(spark, "store")
    s = table(spark, d, "sentenca").select("sentenca_id", "doc_type")
    store.append(s, path)
    store.append(s.where("sentenca_id % 5 = 0").withColumn("doc_type", F.lit("novo")), path)
    store.append(s.where("sentenca_id % 7 = 0"), path, gone=True)
    return store.current(spark, path, ["sentenca_id"])


@query("SELECT unnest(['corpus.conll', 'corpus.jsonl']) AS arquivo")
def q_list_files(spark, d):
    path = scratch(spark, "folder")
    for name in ("corpus.conll", "corpus.jsonl", "outro.txt"):
        spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{path}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    for name in ("corpus.conll", "corpus.jsonl", "outro.txt"):  # one part file of each becomes a plain file
        part = next(s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")) if s.getPath().getName().startswith("part-"))
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.tmp"))
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.tmp"), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    found = [f for s in (".conll", ".jsonl") for f in files.list_files(spark, [path, f"{path}/ausente"], s)]
    return spark.createDataFrame([(f.rsplit("/", 1)[-1],) for f in found], "arquivo string")


# -- views of experiments ------------------------------------------------------------------

# The test tables hold no runs of models, so sessions stand for them, the same way on both sides.
_RUNS = """tr AS (SELECT sessao_id AS id, experimento_id, criado_em, 'modelo' || sessao_id AS modelo FROM sessao_anotacao),
ev AS (SELECT sessao_id AS treinamento_id, sessao_id / 100.0::DOUBLE AS f1_micro FROM sessao_anotacao WHERE sessao_id % 3 <> 0),
an AS (SELECT sessao_id + 1000 AS id, experimento_id, criado_em, 'anon' || sessao_id AS modelo, sessao_id / 50.0::DOUBLE AS coverage, sessao_id / 40.0::DOUBLE AS precision_anon,
  CASE WHEN sessao_id % 4 <> 0 THEN 0.5::DOUBLE END AS f1_original, sessao_id / 30.0::DOUBLE AS f1_anonimizado FROM sessao_anotacao WHERE sessao_id % 5 <> 0),
ex AS (SELECT DISTINCT experimento_id AS id, 'exp ' || experimento_id AS nome FROM sessao_anotacao WHERE experimento_id IS NOT NULL),
lt AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY experimento_id ORDER BY criado_em DESC NULLS LAST, id DESC) = 1),
la AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY experimento_id ORDER BY criado_em DESC NULLS LAST, id DESC) = 1)"""


def _runs(spark, d) -> dict[str, DataFrame]:
    s = table(spark, d, "sessao_anotacao")
    i = F.col("sessao_id")
    return {
        "ex": s.where("experimento_id is not null").select(F.col("experimento_id").alias("id"), F.concat(F.lit("exp "), F.col("experimento_id")).alias("nome")).distinct(),
        "tr": s.select(i.alias("id"), "experimento_id", "criado_em", F.concat(F.lit("modelo"), i).alias("modelo")),
        "ev": s.where(i % 3 != 0).select(i.alias("treinamento_id"), (i / 100.0).alias("f1_micro")),
        "an": s.where(i % 5 != 0).select(
            (i + 1000).alias("id"), "experimento_id", "criado_em", F.concat(F.lit("anon"), i).alias("modelo"), (i / 50.0).alias("coverage"), (i / 40.0).alias("precision_anon"),
            F.when(i % 4 != 0, F.lit(0.5)).alias("f1_original"), (i / 30.0).alias("f1_anonimizado"),
        ),
    }


_RESULTS = f"""WITH {_RUNS}, j AS (SELECT an.id, an.modelo AS Modelo, lt.modelo AS "Modelo NER", round(f1_micro, 4) AS F1_NER, coverage AS Coverage, precision_anon AS "Precision", f1_original AS F1_Original, f1_anonimizado AS F1_Anonimizado,
  round(f1_anonimizado - f1_original, 4) AS DeltaF1 FROM an JOIN lt USING (experimento_id) LEFT JOIN ev ON ev.treinamento_id = lt.id)
  SELECT *, row_number() OVER (ORDER BY F1_NER DESC NULLS LAST, id)::INT AS lugar FROM j"""


@query(_RESULTS)
def q_results_view(spark, d):
    r = _runs(spark, d)
    return results.for_templates(results.results_table(r["an"], r["tr"], r["ev"]))


@query(f"WITH {_RUNS} SELECT tr.id AS treinamento_id, ex.id AS experimento_id, ex.nome, tr.modelo, f1_micro, la.id AS anonimizacao_id, la.coverage, lt.id AS anotacao_id, lt.id AS divisao_id FROM ex JOIN tr ON tr.experimento_id = ex.id LEFT JOIN ev ON ev.treinamento_id = tr.id LEFT JOIN la ON la.experimento_id = ex.id LEFT JOIN lt ON lt.experimento_id = ex.id")
def q_dashboard_full(spark, d):
    r = _runs(spark, d)
    return results.dashboard(r["ex"], r["tr"], r["ev"], r["an"], r["tr"], r["tr"])


@query(f"""WITH {_RUNS}, m AS (SELECT experimento_id, string_agg(id::VARCHAR, ',' ORDER BY criado_em DESC NULLS LAST, id DESC) AS ids, count(*)::INT AS n FROM an GROUP BY 1)
  SELECT ex.id, nome, lt.modelo AS treinamento, coalesce(n, 0) AS anonimizacoes, coalesce(ids, '') AS ids FROM ex LEFT JOIN lt ON lt.experimento_id = ex.id LEFT JOIN m ON m.experimento_id = ex.id""")
def q_experiment_nested(spark, d):
    r = _runs(spark, d)
    x = results.experiment_detail(r["ex"], {"treinamento": r["tr"]}, {"anonimizacoes": r["an"]})
    ids = F.array_join(F.transform("anonimizacoes", lambda a: a["id"].cast("string")), ",")
    return x.select("id", "nome", F.col("treinamento.modelo").alias("treinamento"), F.size("anonimizacoes").alias("anonimizacoes"), ids.alias("ids"))


@query("SELECT sessao_id, row_number() OVER (ORDER BY criado_em DESC NULLS LAST, sessao_id DESC)::INT AS lugar FROM sessao_anotacao WHERE experimento_id = 1")
def q_active_sessions(spark, d):
    from pyspark.sql import Window

    mine = results.active(table(spark, d, "sessao_anotacao"), 1)  # the sessions of one experiment
    return mine.select("sessao_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("criado_em"), F.desc("sessao_id"))).alias("lugar"))


# -- subwords --------------------------------------------------------------------------------

_IDS = {x: k for k, x in enumerate(LABELS)}
_ID_LIST = ", ".join(S.quote(x) for x in LABELS)
_SUB = f"""{S.GOLD}, sw AS (SELECT sentenca_id, posicao, greatest(1, ceil(length(token) / 4.0))::INT AS n, list_position([{_ID_LIST}], label) - 1 AS id FROM gold),
al AS (SELECT sentenca_id, flatten(list(list_concat([id], list_transform(range(n - 1), lambda k: -100)) ORDER BY posicao)) AS l FROM sw GROUP BY 1)"""


@query(f"WITH {_SUB}, w AS (SELECT sentenca_id, l, unnest(range(0, 1 + greatest(0, ceil((len(l) - 32) / 24.0)::INT)))::INT AS janela FROM al) SELECT sentenca_id, janela, list_transform(l[janela * 24 + 1 : janela * 24 + 32], lambda x: x::INT) AS rotulos FROM w")
def q_subword_windows(spark, d):
    return subwords.training_windows(C._labelled_sentences(spark, d), _IDS, subwords.fixed_pieces(4), size=32, stride=8)


_KEEP = f"""WITH {S.GOLD}, sw AS (SELECT sentenca_id, list(greatest(1, ceil(length(token) / 4.0))::INT ORDER BY posicao) AS c, list(label ORDER BY posicao) AS l FROM gold GROUP BY 1),
k AS (SELECT *, list_filter(list_transform(range(0, 1 + greatest(0, ceil((len(c) - 5) / 5.0)::INT)), lambda j: len(c) - 5 * j), lambda m: m <= 5 OR list_sum(c[1:m]) <= 24)[1] AS m FROM sw)
SELECT sentenca_id, m::INT AS palavras, list_concat(l[1:m], list_transform(range(len(l) - m), lambda x: 'O')) AS labels FROM k"""


@query(_KEEP)
def q_truncated_labels(spark, d):
    """The labels an all-knowing model gives if it sees only the words that 24 subwords hold."""
    s = C._labelled_sentences(spark, d).withColumnRenamed("labels", "ouro")
    counts = subwords.fixed_pieces(4)
    done = subwords.predict_within(s, lambda seen: F.slice("ouro", 1, F.size(seen)), counts, limit=24, step=5)
    return done.select("sentenca_id", subwords.kept_words(counts(F.col("tokens")), 24, 5).alias("palavras"), "labels")


# -- more on text, samples and corrections -----------------------------------------------------

_FEATURES = """t AS (SELECT sentenca_id, len(tokens) AS n, unnest(range(len(tokens)))::INT AS posicao, unnest(tokens) AS token, tokens FROM sentenca),
f AS (SELECT *, CASE WHEN posicao > 0 THEN tokens[posicao] END AS p1, CASE WHEN posicao > 1 THEN tokens[posicao - 1] END AS p2, tokens[posicao + 2] AS n1, tokens[posicao + 3] AS n2 FROM t)"""


def _upper(c: str) -> str:
    return f"(regexp_matches({c}, '\\p{{Lu}}') AND NOT regexp_matches({c}, '[\\p{{Ll}}\\p{{Lt}}ªº]'))"


def _title(c: str) -> str:
    return f"regexp_matches({c}, '^\\P{{L}}*[\\p{{Lu}}\\p{{Lt}}]\\p{{Ll}}*(?:\\P{{L}}+[\\p{{Lu}}\\p{{Lt}}]\\p{{Ll}}*)*\\P{{L}}*$')"


_ABBREV = ", ".join(S.quote(a) for a in P.ABBREVIATIONS)


C.ORACLE_SQL["q_features"] = f"""WITH {_FEATURES} SELECT sentenca_id, posicao, lower(token) AS lower, right(lower(token), 2) AS suffix2, right(lower(token), 3) AS suffix3, left(lower(token), 2) AS prefix2, left(lower(token), 3) AS prefix3,
  {_upper('token')} AS isupper, {_title('token')} AS istitle, regexp_matches(token, '^[\\p{{Nd}}²³¹]+$') AS isdigit, regexp_replace(token, '\\.$', '') IN ({_ABBREV}) AS is_abrev, regexp_matches(token, '^__.*__$') AS is_placeholder,
  posicao = 0 AS is_first, posicao = n - 1 AS is_last, lower(p1) AS prev_lower, lower(p2) AS prev2_lower, lower(n1) AS next_lower, lower(n2) AS next2_lower,
  {_upper('p1')} AS prev_isupper, {_title('p1')} AS prev_istitle, {_upper('n1')} AS next_isupper, {_title('n1')} AS next_istitle, posicao = 0 AS BOS, posicao = n - 1 AS EOS FROM f"""


def _detector(c: str, pattern: str) -> str:
    """RE2 has no look-behind: a capital run that starts a word is looked for after the start or a character that is none of a word."""
    pattern = pattern.replace("(?<!\\w)", "(?:^|[^\\p{L}\\p{N}_])").replace("\\s", f"[{S.BLANKS}]")
    return f"regexp_matches({c}, {S.quote(pattern)})"


_TYPES = "list_filter([" + ", ".join(f"CASE WHEN {_detector('x', p)} THEN {S.quote(n)} END" for n, (p, _) in P.DETECTORS.items()) + "], lambda t: t IS NOT NULL)"
_TYPED = f"typed AS (SELECT sentenca_id, {_TYPES} AS tipos, x FROM (SELECT sentenca_id, array_to_string(tokens, ' ') AS x FROM sentenca))"


C.ORACLE_SQL["q_phi_detect"] = f"WITH {_TYPED} SELECT sentenca_id, tipos FROM typed"


_QUOTA = ", ".join(f"({S.quote(n)}, {q})" for n, (_, q) in P.DETECTORS.items())
_ORDER = "substr(md5('42|' || sentenca_id), 1, 15), sentenca_id"
_CHOSEN = f"""{_TYPED}, quotas(tipo, cota) AS (VALUES {_QUOTA}), firsts AS (SELECT min(sentenca_id) AS sentenca_id FROM typed GROUP BY x), uni AS (SELECT sentenca_id, tipos FROM typed JOIN firsts USING (sentenca_id)),
rk AS (SELECT sentenca_id, tipo, row_number() OVER (PARTITION BY tipo ORDER BY {_ORDER}) AS r FROM (SELECT sentenca_id, unnest(tipos) AS tipo FROM uni)),
chosen AS (SELECT DISTINCT sentenca_id FROM rk JOIN quotas USING (tipo) WHERE r <= cota)"""


C.ORACLE_SQL["q_quota_sample"] = f"""WITH {_CHOSEN}, spare AS (SELECT sentenca_id, row_number() OVER (ORDER BY {_ORDER}) AS r FROM uni WHERE sentenca_id NOT IN (SELECT sentenca_id FROM chosen))
  SELECT sentenca_id, 'cota' AS motivo FROM chosen UNION ALL SELECT sentenca_id, 'complemento' FROM spare WHERE r <= 1500 - (SELECT count(*) FROM chosen)"""


C.ORACLE_SQL["q_quota_report"] = f"""WITH {_CHOSEN}, n AS (SELECT tipo, count(*) AS k FROM rk GROUP BY 1) SELECT tipo, coalesce(k, 0) AS candidatos, cota::BIGINT AS cota, least(coalesce(k, 0), cota)::BIGINT AS selecionadas, coalesce(k, 0) >= cota AS cota_atingida,
  tipo IN ('DATA', 'HORA', 'CONTATO') AS regex_tratado FROM quotas LEFT JOIN n USING (tipo)"""


C.ORACLE_SQL["q_selected_distribution"] = f"WITH {_CHOSEN}, e AS (SELECT unnest(tipos) AS tipo FROM typed WHERE sentenca_id IN (SELECT sentenca_id FROM chosen)) SELECT tipo, count(*) AS sentencas FROM e GROUP BY 1"


_ANEW = f"regexp_extract_all({S.rules(S.rules('x', P.GLUE), S.MASKS)}, {S.quote(P.TOKEN)})"


@query(f"WITH n AS (SELECT len(tokens) AS k, tokens, {_ANEW} AS anew FROM (SELECT tokens, array_to_string(tokens, ' ') AS x FROM sentenca)) SELECT CASE WHEN anew <> tokens THEN (len(anew) - k)::INT END AS delta, count(*) AS sentencas FROM n WHERE tokens IS NOT NULL GROUP BY 1")
def q_length_changes(spark, d):
    return remap.length_changes(table(spark, d, "sentenca").where("tokens is not null"))


_SIMPLE = ", ".join(f"WHEN {S.quote(k)} THEN {S.quote(v)}" .replace(", ", " ") for k, v in P.MARKERS.items()).replace(", WHEN", " WHEN")


C.ORACLE_SQL["q_markers_simple"] = f"""WITH {S.GOLD}, {S.spans('gold', 'label', 'strict', 'sp')}, m AS (SELECT * FROM sp WHERE tipo NOT IN ('DATA', 'HORA', 'CONTATO')),
  p AS (SELECT g.sentenca_id, g.posicao, g.token, m.inicio, m.tipo FROM gold g LEFT JOIN m ON m.sentenca_id = g.sentenca_id AND g.posicao >= m.inicio AND g.posicao < m.fim)
  SELECT sentenca_id, coalesce(string_agg(CASE WHEN inicio IS NULL THEN token ELSE CASE tipo {_SIMPLE} END END, ' ' ORDER BY posicao) FILTER (WHERE inicio IS NULL OR inicio = posicao), '') AS texto FROM p GROUP BY 1"""


@query(f"WITH {S.GOLD} SELECT tokens, labels FROM (SELECT sentenca_id, list(token ORDER BY posicao) AS tokens, list(label ORDER BY posicao) AS labels FROM gold GROUP BY 1) WHERE false")
def q_import_empty(spark, d):
    """Sentences without spans import as sentences without labels; an empty table as an empty one."""
    empty = table(spark, d, "sentenca").where("false").select(F.array_join("tokens", " ").alias("text"), F.lit(None).cast("array<array<string>>").alias("label"))
    return files.import_spans(empty)


@query(f"""WITH {S.GRID}, {S.DECIDED}, g1 AS (SELECT g.sentenca_id, g.posicao, g.token, coalesce(d.label, g.a1) AS label, a1, a2 FROM grid g LEFT JOIN decided d ON d.sentenca_id = g.sentenca_id AND d.posicao = g.posicao),
  {S.spans('g1', 'label', 'seqeval', 'o')}, {S.spans('g1', 'a1', 'seqeval', 'x')}, {S.spans('g1', 'a2', 'seqeval', 'y')},
  """ + ", ".join(f"""m{k} AS (SELECT coalesce(o.tipo, z.tipo) AS tipo, o.tipo IS NOT NULL AS g, z.tipo IS NOT NULL AS f FROM o FULL JOIN {k} z ON o.sentenca_id = z.sentenca_id AND o.inicio = z.inicio AND o.fim = z.fim AND o.tipo = z.tipo),
  c{k} AS (SELECT tipo, count_if(g AND f) AS tp, count_if(f AND NOT g) AS fp, count_if(g AND NOT f) AS fn FROM m{k} GROUP BY 1),
  s{k} AS (SELECT tipo, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c{k}), f{k} AS (SELECT tipo, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM s{k})""" for k in "xy") + """,
  d AS (SELECT coalesce(fx.tipo, fy.tipo) AS tipo, round(coalesce(fy.f1, 0) - coalesce(fx.f1, 0), 4) AS delta FROM fx FULL JOIN fy ON fx.tipo = fy.tipo)
  SELECT tipo, delta FROM d UNION ALL SELECT '_geral', round(avg(delta), 4) FROM d""")
def q_delta_f1(spark, d):
    """Scores of the second annotator less those of the first, both against the gold labels."""
    g = C._grid(spark, d)
    gold = C._gold(spark, d)
    truth = C.spans.bio_spans(gold, "seqeval")
    first, second = (metrics.entity_scores(truth, found, by_type=True) for found in metrics.compared_spans(g, "seqeval"))
    return metrics.delta_f1(first, second)


@query(f"""WITH {S.GOLD}, e AS (SELECT g.sentenca_id, substr(label, 3) AS tipo, particao FROM gold g JOIN divisao USING (sentenca_id) WHERE label <> 'O' AND particao IN ('treino', 'dev', 'teste')),
  w AS (SELECT tipo, count_if(particao = 'treino') AS treino, count_if(particao = 'dev') AS dev, count_if(particao = 'teste') AS teste FROM e GROUP BY 1) SELECT *, treino = 0 OR (dev > 0 AND teste > 0) AS ok FROM w""")
def q_split_token_check(spark, d):
    return sampling.split_token_check(C._gold(spark, d), table(spark, d, "divisao").select("sentenca_id", "particao"))


@query(f"WITH {S.GOLD}, {S.spans('gold', 'label', 'strict', 'sp')}, r AS (SELECT sentenca_id, inicio, fim - inicio AS tamanho, texto, row_number() OVER (ORDER BY sentenca_id, inicio) AS k FROM sp WHERE tipo = 'DATA' AND fim - inicio >= 3) SELECT sentenca_id, inicio, tamanho, texto FROM r WHERE k <= 20")
def q_audit_long_dates(spark, d):
    return audit.long_spans(C._gold_spans(spark, d), "DATA", least=3, most=20)


_PARTS = S.quote(audit.GLUED_PARTS)


@query(f"WITH {S.GOLD}, t AS (SELECT sentenca_id, posicao, token || CASE WHEN posicao % 2 = 0 THEN '.Silva' ELSE '' END AS token, label FROM gold WHERE label <> 'O') SELECT *, regexp_extract(token, {_PARTS}, 1) AS prefixo, regexp_extract(token, {_PARTS}, 2) AS sufixo FROM t WHERE regexp_matches(token, {_PARTS})")
def q_audit_glued(spark, d):
    """The test tables hold no glued tokens: a name is stuck to every other one."""
    stuck = F.concat("token", F.when(F.col("posicao") % 2 == 0, ".Silva").otherwise(""))
    return audit.glued_tokens(C._gold(spark, d).withColumn("token", stuck))


@query(f"""WITH {S.GOLD}, p AS (SELECT *, lag(label) OVER (PARTITION BY sentenca_id ORDER BY posicao) AS antes FROM gold)
  SELECT sentenca_id, posicao, token, CASE WHEN label = 'B-INSTITUICAO' AND substr(coalesce(antes, 'O'), 3) = 'PESSOA' THEN 'I-PESSOA' WHEN label = 'B-INSTITUICAO' THEN 'B-PESSOA' ELSE label END AS label FROM p""")
def q_relabel_names(spark, d):
    """Guarded corrections to PESSOA that continue the name before them."""
    g = C._gold(spark, d)
    fix = g.where("label = 'B-INSTITUICAO'").select("sentenca_id", "posicao", "token", F.col("label").alias("label_antigo"), F.lit("PESSOA").alias("tipo_novo"))
    return remap.relabel_continuing(g, fix).select("sentenca_id", "posicao", "token", "label")


@query(f"""WITH {S.LATEST}, n AS (SELECT sentenca_id, len(tokens) AS k, tokens, {_ANEW} AS anew FROM (SELECT sentenca_id, tokens, array_to_string(tokens, ' ') AS x FROM sentenca)), ch AS (SELECT * FROM n WHERE anew <> tokens),
  c AS (SELECT sentenca_id, anotador_id, count(*) FILTER (WHERE posicao < k) AS dentro, count(*) FILTER (WHERE posicao >= k) AS fora, any_value(k) AS k FROM ch JOIN latest USING (sentenca_id) GROUP BY ALL)
  SELECT sentenca_id, anotador_id, dentro = k AND fora = 0 AS cobre FROM c""")
def q_plan_coverage(spark, d):
    return remap.plan_coverage(table(spark, d, "sentenca"), C.labels.latest_annotations(table(spark, d, "anotacao_token")))


_CLEAN = "regexp_replace(regexp_replace(list_aggregate(list_filter(string_split(nfc_normalize(replace(t, chr(9), ' ')), ''), lambda x: x = chr(10) OR NOT regexp_matches(x, '[\\p{Cc}\\p{Cf}\\p{Co}]')), 'string_agg', ''), ' +', ' ', 'g'), '(?m)^[" + S.BLANKS_IN_LINE + "]+|[" + S.BLANKS_IN_LINE + "]+$', '', 'g')"
_NORMAL = f"{S.WRITTEN_NOTES}, cl AS (SELECT nr_registro, doc_type, coalesce({_CLEAN}, '') AS t FROM an), no AS (SELECT nr_registro, doc_type, {S.rules(S.rules('t', P.GLUE), S.MASKS)} AS t FROM cl)"


def _plain_digits(spark, d) -> DataFrame:
    return C._written(spark, d).withColumnRenamed("t", "texto")


@query(f"WITH {_NORMAL} SELECT nr_registro, t AS texto FROM no")
def q_normalize_written(spark, d):
    return _plain_digits(spark, d).select("nr_registro", C.T.normalize(F.col("texto")).alias("texto"))


_NORMAL_SENT = _NORMAL + C._SENT.removeprefix(S.WRITTEN_NOTES).replace("FROM an)", "FROM no)")


@query(f"WITH {_NORMAL_SENT} SELECT nr_registro, doc_type, ordem, regexp_extract_all(sentenca, {S.quote(P.TOKEN)}) AS tokens FROM sent")
def q_corpus_written(spark, d):
    return C.corpus.note_tokens(_plain_digits(spark, d)).select("nr_registro", "doc_type", "ordem", "tokens")


_HELD = ", ".join(S.quote(k) for k in P.PLACEHOLDERS)
_SHOWN = " ".join(f"WHEN {S.quote(k)} THEN {S.quote(v)}" for k, v in P.PLACEHOLDERS.items())


@query(f"""WITH {_NORMAL}, k AS (SELECT nr_registro, regexp_extract_all(t, {S.quote(P.TOKEN)}) AS w FROM no)
  SELECT nr_registro, array_to_string(list_transform(w, lambda x: CASE x {_SHOWN} ELSE x END), ' ') AS texto_anonimizado, len(list_filter(w, lambda x: x IN ({_HELD})))::INT AS n_phi_regex, 0 AS n_phi_ner, len(list_filter(w, lambda x: x IN ({_HELD})))::INT AS n_phi_total FROM k""")
def q_anonymize_written(spark, d):
    return C.anonymize.anonymise(_plain_digits(spark, d)).select("nr_registro", "texto_anonimizado", "n_phi_regex", "n_phi_ner", "n_phi_total")


@query(f"WITH {_LABELLED} SELECT count(*) AS sentencas, sum(len(tokens))::BIGINT AS tokens, sum(len(list_filter(labels, lambda x: x LIKE 'B-%')))::BIGINT AS entidades FROM lab")
def q_sanity_counts(spark, d):
    path = scratch(spark, "sanity")
    files.write_conll(C._labelled_sentences(spark, d), path)
    return pipelines.sanity_counts(spark, path)


@query("SELECT doc_type, least(count(*), 400 // (SELECT count(DISTINCT doc_type) FROM sentenca))::BIGINT AS sentencas FROM sentenca WHERE doc_type IS NOT NULL GROUP BY 1")
def q_annotation_sample(spark, d):
    path = scratch(spark, "sample")
    files.write_sentences(table(spark, d, "sentenca").where("size(tokens) > 0"), path)
    return pipelines.annotation_sample(path, f"{path}-tool", spark, 400)


@query()
def q_remap_annotations(spark, d):
    """What processing anew does to the annotated sentences: how many are carried over, held back or unchanged."""
    return remap.remap_annotations(table(spark, d, "sentenca"), C.labels.latest_annotations(table(spark, d, "anotacao_token"))).counters


@query()
def q_remap_review(spark, d):
    return remap.review_report(C._labelled_sentences(spark, d))
