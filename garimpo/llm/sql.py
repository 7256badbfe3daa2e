"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

# Letters of other scripts and the Latin letters they look like, place by place.
_FOREIGN = "аеорсухіѕјһԁԛԝАВЕКМНОРСТХУІЅЈԚԜοναικρχυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LATIN = "aeopcyxisjhdqwABEKMHOPCTXYISJQWovaikpxuABEZHIKMNOPTYX"

_FOLD = "lower(strip_accents(trim({0})))"

P1_FOUND = f"""
WITH n AS (SELECT {_FOLD.format('doc_type')} AS c, count(*) AS k FROM sentenca WHERE doc_type IS NOT NULL GROUP BY 1),
     t AS (SELECT count(*) AS total FROM sentenca)
SELECT DISTINCT plano_id, p.doc_type
FROM plano_amostra p CROSS JOIN t LEFT JOIN n ON n.c = {_FOLD.format('p.doc_type')}
WHERE coalesce(k, 0) < proporcao * floor(fracao * total) OR coalesce(k, 0) < minimo
"""

P4_FOUND = """
WITH RECURSIVE links AS (
  SELECT DISTINCT doc_id, TRY_CAST(regexp_extract(regexp_replace(cd_paciente, '\\s', '', 'g'), '^0*(\\d{1,18})(?:[.,]0*)?$', 1) AS BIGINT) AS p
  FROM sentenca WHERE doc_id IS NOT NULL),
known AS (SELECT * FROM links WHERE p > 0),
ties AS (SELECT DISTINCT a.p AS a, b.p AS b FROM known a JOIN known b USING (doc_id) WHERE a.p <> b.p),
reach(a, b) AS (SELECT a, b FROM ties UNION SELECT r.a, t.b FROM reach r JOIN ties t ON r.b = t.a)
SELECT a AS cd_paciente_a, b AS cd_paciente_b FROM reach WHERE a < b
"""

P9_FOUND = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(texto)), '[\\p{L}\\p{N}]+') AS w FROM itens_avaliacao WHERE texto IS NOT NULL),
     dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS k FROM d)),
     ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_THIN = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
P3_FOUND = f"""
WITH t AS (SELECT nr_registro AS id, ds_evolucao AS x FROM prescricoes UNION ALL SELECT nr_registro, ds_parecer FROM pareceres),
a AS (SELECT id, x, regexp_replace(regexp_replace(x, '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}\\x{{FE00}}-\\x{{FE0F}}\\x{{34F}}]', '', 'g'),
  '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\t]', ' ', 'g') AS y FROM t WHERE x IS NOT NULL),
c AS (SELECT id, x, nfc_normalize(translate(translate(replace(replace(y, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{_WIDE}', '{_THIN}'), '{_FOREIGN}', '{_LATIN}')) AS k FROM a)
SELECT a.id AS nr_registro_a, b.id AS nr_registro_b FROM c a JOIN c b ON a.k = b.k AND a.id < b.id AND a.x <> b.x
"""

P3_FORMS = P3_FOUND[: P3_FOUND.rindex("SELECT a.id")] + "SELECT id AS nr_registro, k AS form FROM c"

_P9_RUNS = P9_FOUND[: P9_FOUND.rindex("SELECT DISTINCT")].replace("SELECT doc_id, array_to_string", "SELECT doc_id, k, array_to_string").replace("SELECT item_id, array_to_string", "SELECT item_id, k, array_to_string")
P9_PASSAGES = f"""{_P9_RUNS}, h AS (SELECT doc_id, item_id, dg.k - 1 AS dpos, ig.k - 1 AS ipos, dg.k - ig.k AS shift FROM dg JOIN ig USING (g)),
r AS (SELECT *, ipos - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY ipos) AS island FROM h)
SELECT doc_id, item_id, min(dpos)::INT AS doc_from, min(ipos)::INT AS item_from, (count(*) + 11)::INT AS words FROM r GROUP BY doc_id, item_id, shift, island
"""

# Longest common subsequences by the plain table, row after row, of the pairs whose distinct words leave room for one.
_P5_PAIRS = """w AS (SELECT sentenca_id, list_filter(list_transform(tokens, lambda t: lower(strip_accents(t))), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]')) AS w FROM sentenca),
sides AS (SELECT DISTINCT w.sentenca_id, lower(trim(particao)) AS p, w, len(w) AS n, list_distinct(w) AS dw FROM w JOIN divisao USING (sentenca_id) WHERE len(w) >= 24 AND lower(trim(particao)) IN ('treino', 'dev', 'teste')),
c AS (SELECT a.sentenca_id AS t, b.sentenca_id AS e, a.w AS x, b.w AS y, 0.85 * greatest(a.n, b.n) - 1e-9 AS need FROM (SELECT * FROM sides WHERE p = 'treino') a JOIN (SELECT DISTINCT ON (sentenca_id) * FROM sides WHERE p <> 'treino') b
  ON least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9 AND a.sentenca_id <> b.sentenca_id AND len(list_intersect(a.dw, b.dw)) >= len(a.dw) - (a.n - (0.85 * greatest(a.n, b.n) - 1e-9))),
m AS (SELECT t, e, need, list_transform(x, lambda u: list_transform(y, lambda v: (u = v)::INT)) AS hits, list_transform(range(len(y)), lambda j: [j::INT]) AS js, list_transform(range(len(y) + 1), lambda j: 0::INT) AS zero FROM c),
l AS (SELECT t, e, need, list_reduce(hits, lambda prev, hit: list_reduce(js, lambda acc, j: list_append(acc, greatest(acc[-1], prev[j[1] + 2], prev[j[1] + 1] + hit[j[1] + 1])), [0::INT]), zero)[-1] AS common FROM m),
pairs AS (SELECT t, e FROM l WHERE common >= need)"""
P5_FOUND = f"WITH {_P5_PAIRS} SELECT DISTINCT least(t, e) AS sentenca_id_a, greatest(t, e) AS sentenca_id_b FROM pairs"
P5_REPORT = f"""WITH {_P5_PAIRS}, k AS (SELECT e, count(*) AS n FROM pairs GROUP BY 1), ev AS (SELECT DISTINCT sentenca_id, lower(trim(particao)) AS particao, origem FROM divisao WHERE particao IN ('dev', 'teste'))
SELECT particao, origem, count(*) AS sentencas, count(n) AS sobrepostas, coalesce(sum(n), 0)::BIGINT AS pares FROM ev LEFT JOIN k ON k.e = ev.sentenca_id GROUP BY ALL"""

_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in ["O", *[f"{p}-{t}" for t in ("PESSOA", "DATA", "ENDERECO", "CONTATO", "DOCUMENTO", "HORA", "INSTITUICAO") for p in "BI"]]) + "]"
_VOTES = f"""coded AS (SELECT sentenca_id, anotador_id, posicao, atualizado_em, label IS NULL AS none, coalesce(list_position({_LABEL_LIST}, upper(strip_accents(trim(label)))), 0) AS code FROM anotacao_token WHERE posicao >= 0),
last AS (SELECT * FROM coded QUALIFY row_number() OVER (PARTITION BY sentenca_id, anotador_id, posicao ORDER BY atualizado_em DESC NULLS LAST, none, code DESC) = 1),
v AS (SELECT sentenca_id, posicao, anotador_id AS who, code FROM last JOIN (SELECT sentenca_id, len(tokens) AS n FROM sentenca) USING (sentenca_id) WHERE code > 0 AND posicao < n),
cnt AS (SELECT who, code, count(*) AS k FROM v GROUP BY who, code), dist AS (SELECT who, code, k / sum(k) OVER (PARTITION BY who) AS p FROM cnt),
chance AS (SELECT a.who AS a, b.who AS b, sum(a.p * b.p) AS q FROM dist a JOIN dist b USING (code) GROUP BY ALL),
met AS (SELECT x.who AS a, y.who AS b, count(*) AS itens, count_if(x.code = y.code) AS iguais FROM v x JOIN v y USING (sentenca_id, posicao) WHERE x.who <> y.who GROUP BY ALL),
agreed AS (SELECT a, b, itens, iguais, coalesce(q, 0) AS acaso, (iguais / itens - coalesce(q, 0)) / greatest(1e-6, 1 - coalesce(q, 0)) * itens / (itens + 20) AS acordo FROM met LEFT JOIN chance USING (a, b)),
power(step, who, x) AS (SELECT 0, b, 1.0::DOUBLE FROM (SELECT DISTINCT b FROM agreed) UNION ALL
  SELECT step + 1, who, y / greatest(1e-12, max(abs(y)) OVER ()) FROM (SELECT step, a AS who, sum(acordo * x) AS y FROM power JOIN agreed ON agreed.b = power.who WHERE step < 64 GROUP BY ALL)),
weights AS (SELECT who, greatest(0.001, x) AS peso FROM power WHERE step = 64)"""
P2_AGREEMENT = f"WITH RECURSIVE {_VOTES} SELECT a, b, itens::BIGINT AS itens, iguais::BIGINT AS iguais, round(acaso, 6) AS acaso, round(acordo, 6) AS acordo FROM agreed WHERE a < b"
P2_RELIABILITY = f"WITH RECURSIVE {_VOTES} SELECT who AS anotador_id, round(peso, 6) AS peso FROM weights"
_FINAL = f"""{_VOTES}, ruled AS (SELECT sentenca_id, posicao, list_position({_LABEL_LIST}, upper(strip_accents(trim(label)))) AS r FROM adjudicacao_token WHERE label IS NOT NULL),
span AS (SELECT sentenca_id, posicao, min(code) <> max(code) AS differ, max(code) = 1 AS fundo FROM v GROUP BY ALL),
kept AS (SELECT v.* FROM v JOIN span USING (sentenca_id, posicao) WHERE NOT fundo),
sums AS (SELECT sentenca_id, posicao, code, sum(coalesce(peso, 0.001)) AS w FROM kept LEFT JOIN weights USING (who) GROUP BY ALL),
first AS (SELECT sentenca_id, posicao, coalesce(max(r), arg_max(code, (w, code))) AS c1 FROM sums LEFT JOIN ruled USING (sentenca_id, posicao) GROUP BY sentenca_id, posicao),
j AS (SELECT kept.*, c1 FROM kept JOIN first USING (sentenca_id, posicao)),
n AS (SELECT who, code, c1, count(*) AS k FROM j GROUP BY ALL), tot AS (SELECT who, c1, count(*) AS k FROM j GROUP BY ALL),
truths AS (SELECT unnest(range(1, 16)) AS c1), prior AS (SELECT c1, count(*) AS k FROM first GROUP BY 1),
said AS (SELECT DISTINCT who, code FROM j),
ev AS (SELECT s.who, s.code, t.c1, ln((coalesce(n.k, 0) + CASE WHEN s.code = t.c1 THEN 0.52 ELSE 0.02 END) / (coalesce(tot.k, 0) + 0.8)) AS e FROM said s CROSS JOIN truths t
  LEFT JOIN n ON n.who = s.who AND n.code = s.code AND n.c1 = t.c1 LEFT JOIN tot ON tot.who = s.who AND tot.c1 = t.c1),
score AS (SELECT kept.sentenca_id, kept.posicao, ev.c1, sum(e) AS e FROM kept JOIN ev USING (who, code) GROUP BY ALL),
best AS (SELECT sentenca_id, posicao, arg_max(c1, (t, c1)) AS c FROM (SELECT sentenca_id, posicao, s.c1, e + ln((coalesce(k, 0) + 1) / ((SELECT count(*) FROM first) + 15)) AS t FROM score s LEFT JOIN prior ON prior.c1 = s.c1) GROUP BY sentenca_id, posicao),
final AS (SELECT span.sentenca_id, span.posicao, differ, r IS NOT NULL AS known, {_LABEL_LIST}[coalesce(r, c, 1)] AS label FROM span LEFT JOIN best USING (sentenca_id, posicao) LEFT JOIN ruled USING (sentenca_id, posicao))"""
P2_FOUND = f"WITH RECURSIVE {_FINAL} SELECT sentenca_id, posicao, label FROM final WHERE differ"
P2_LABELS = f"WITH RECURSIVE {_FINAL} SELECT sentenca_id, posicao, label, CASE WHEN known THEN 'adjudicacao' ELSE 'consenso' END AS origem FROM final"

ORACLE_SQL: dict[str, str] = {
    "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_labels": P2_LABELS, "p2_agreement": P2_AGREEMENT, "p2_reliability": P2_RELIABILITY, "p3_found": P3_FOUND, "p3_forms": P3_FORMS,
    "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p9_found": P9_FOUND, "p9_passages": P9_PASSAGES,
}
