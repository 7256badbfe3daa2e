"""Training-data operators against brute force, exact round trips and defined edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("garimpo.llm")

from garimpo.llm import components, consensus, encode, glyphs, leak, level, linked_split, lookalike, overlap, pii, pii_spans, proportions
from garimpo.llm.boosting import BoostedTrees
from garimpo.llm.words import words

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- proportions --------------------------------------------------------------------------


def test_allocation_prefers_siblings():
    cats = [("a", "p", 0.5, 0, 10), ("b", "p", 0.3, 0, 100), ("c", "q", 0.2, 0, 100)]
    got = proportions.allocate(cats, 100)
    assert {k: v[0] for k, v in got.items()} == {"a": 10, "b": 70, "c": 20} and got["b"][1] == 40
    far = proportions.allocate([("a", "p", 0.5, 0, 10), ("b", "p", 0.3, 0, 35), ("c", "q", 0.2, 0, 100)], 100)
    assert {k: v[0] for k, v in far.items()} == {"a": 10, "b": 35, "c": 55} and far["c"][2] == 35


def test_allocation_never_exceeds():
    random.seed(2)
    for _ in range(200):
        k = random.randint(1, 6)
        share = np.random.default_rng(random.randint(0, 99)).dirichlet(np.ones(k))
        cats = [(str(i), random.choice("pq"), float(share[i]), random.randint(0, 4), random.randint(0, 60)) for i in range(k)]
        n = random.randint(0, 120)
        got = proportions.allocate(cats, n)
        assert all(0 <= got[c][0] <= h for c, _, _, _, h in cats)
        floors = sum(min(m, h) for _, _, _, m, h in cats)
        assert sum(v[0] for v in got.values()) <= max(n, floors)


def test_sample_by_plan(spark):
    s = spark.createDataFrame([(i, t, "x") for i, t in enumerate([" Alta"] * 50 + ["álta "] * 10 + ["parecer"] * 40 + [None] * 10)], "sentenca_id bigint, doc_type string, plano_id string")
    p = spark.createDataFrame([(1, 0.5, "alta", 0.5, 1), (1, 0.5, "parecer", 0.4, 1), (1, 0.5, "obito", 0.1, 2), (1, 0.5, None, 0.0, 1)], "plano_id int, fracao double, doc_type string, proporcao double, minimo int")
    rep = {r["doc_type"]: r for r in proportions.plan_report(s, p).collect()}
    assert rep["alta"]["existentes"] == 60 and rep["alta"]["atendido"] and not rep["obito"]["atendido"] and not rep[None]["atendido"]
    drawn = proportions.sample_by_plan(s, p, "sentenca_id")
    assert drawn.count() == drawn.select("sentenca_id").distinct().count() == 55
    assert proportions.plan_report(s.where("false"), p).where("tamanho > 0").count() == 0
    assert proportions.sample_by_plan(s.where("false"), p, "sentenca_id").count() == 0


# -- consensus ------------------------------------------------------------------------------


def test_consensus_beats_majority(spark):
    random.seed(7)
    good, bad = [1, 2, 3, 4, 5], [6, 7, 8]
    shift = {"B-PESSOA": "B-DATA", "B-DATA": "B-HORA", "B-HORA": "B-PESSOA", "O": "O"}
    truth, votes = {}, []
    for s in range(400):
        for p in range(3):
            truth[s, p] = random.choice(["B-PESSOA", "B-DATA", "B-HORA", "O"])
        who = random.sample(good, 1) + random.sample(bad, 2) if s % 2 else random.sample(good + bad, 4)
        for a in who:
            for p in range(3):
                x = truth[s, p]
                x = (x if random.random() < 0.95 else "O") if a in good else (shift[x] if random.random() < 0.8 else x)
                votes.append((s, a, p, random.choice([x, f" {x.lower()} "]), 1))
    votes += [(0, 1, 99, "O", 1), (0, 1, -1, "O", 1), (0, 1, 0, None, 0), (0, 2, 0, "??", 5)]
    ann = spark.createDataFrame(votes, "sentenca_id bigint, anotador_id bigint, posicao int, label string, t int").select(
        "*", F.timestamp_seconds("t").alias("criado_em"), F.timestamp_seconds("t").alias("atualizado_em")
    )
    sent = spark.createDataFrame([(s, ["a", "b", "c"]) for s in range(400)] + [(999, None)], "sentenca_id bigint, tokens array<string>")
    adj = spark.createDataFrame([(1, 0, "i-hora "), (1, 1, None)], "sentenca_id bigint, posicao int, label string").withColumn("criado_em", F.timestamp_seconds(F.lit(1)))
    labels, weights, pairs = consensus.consensus(ann, sent, adj)
    got = {(r["sentenca_id"], r["posicao"]): r for r in labels.collect()}
    assert got.get((1, 0)) is None or got[1, 0]["label"] == "I-HORA"
    diff = [k for k, r in got.items() if r["differ"] and r["origem"] == "consenso"]
    acc = np.mean([got[k]["label"] == truth[k] for k in diff])
    assert acc > 0.93
    w = {r["anotador_id"]: r["peso"] for r in weights.collect()}
    assert min(w[a] for a in good) > max(w[a] for a in bad)
    # The eigenvector against numpy on the same matrix.
    m = np.zeros((9, 9))
    for r in pairs.collect():
        m[r["a"], r["b"]] = r["acordo"]
    value, vector = np.linalg.eigh(m)
    lead = np.abs(vector[:, value.argmax()])
    assert all(abs(w[a] - lead[a] / lead.max()) < 0.01 for a in good)


def test_consensus_empty(spark):
    ann = spark.createDataFrame([], "sentenca_id bigint, anotador_id bigint, posicao int, label string, criado_em timestamp, atualizado_em timestamp")
    sent = spark.createDataFrame([], "sentenca_id bigint, tokens array<string>")
    adj = spark.createDataFrame([], "sentenca_id bigint, posicao int, label string, criado_em timestamp")
    labels, weights, pairs = consensus.consensus(ann, sent, adj)
    assert labels.count() == weights.count() == pairs.count() == 0


def test_agreement_counts_background(spark):
    say = {1: ["O", "O", "O", "B-DATA"], 2: ["O", "O", "O", "B-HORA"], 3: ["O", "O"]}
    votes = [(0, a, p, x) for a, xs in say.items() for p, x in enumerate(xs)] + [(1, a, p, "O") for a in (4, 5) for p in range(3)]
    ann = spark.createDataFrame(votes, "sentenca_id bigint, anotador_id bigint, posicao int, label string").withColumns({c: F.timestamp_seconds(F.lit(1)) for c in ("criado_em", "atualizado_em")})
    sent = spark.createDataFrame([(s, ["a", "b", "c", "d", "e"]) for s in range(2)], "sentenca_id bigint, tokens array<string>")
    adj = spark.createDataFrame([(0, 0, "B-PESSOA"), (0, 3, "B-DATA"), (1, 4, "B-DATA")], "sentenca_id bigint, posicao int, label string").withColumn("criado_em", F.timestamp_seconds(F.lit(1)))
    labels, weights, pairs = consensus.consensus(ann, sent, adj)
    got = {(r["a"], r["b"]): r for r in pairs.collect() if r["a"] < r["b"]}
    assert {k: (r["itens"], r["iguais"]) for k, r in got.items()} == {(1, 2): (4, 3), (1, 3): (2, 2), (2, 3): (2, 2), (4, 5): (3, 3)}
    assert abs(got[1, 2]["acaso"] - 0.75 * 0.75) < 1e-9 and abs(got[1, 3]["acaso"] - 0.75) < 1e-9
    assert {r["anotador_id"] for r in weights.collect()} == {1, 2, 3, 4, 5}
    assert rows(labels.select("sentenca_id", "posicao", "label", "origem", "differ")) == [
        (0, 0, "B-PESSOA", "adjudicacao", False), (0, 1, "O", "consenso", False), (0, 2, "O", "consenso", False), (0, 3, "B-DATA", "adjudicacao", True),
        *[(1, p, "O", "consenso", False) for p in range(3)],
    ]


# -- look-alikes --------------------------------------------------------------------------------


def test_forms_and_pairs(spark):
    data = [
        (1, "Paciente não come"),
        (2, "Ｐaciente não come"),
        (3, "Pаciente não c​ome"),  # Cyrillic a, hard blank, no width
        (4, "Paciente nao come"),
        (5, "ﬁm de 2² dias"),
        (6, "fim de 2² dias"),
        (7, "fim de 22 dias"),
        (8, None),
        (9, ""),
        (10, "Paciente não come"),
        (11, "Москва город"),
        (12, "Pаciente não  come"),
        (13, "fim\nde 2² dias"),
        (14, "x" * 200_000 + "​"),
    ]
    df = spark.createDataFrame(data, "id bigint, text string").withColumn("form", F.lit(0)).withColumn("odd", F.lit(0))
    forms = {r["id"]: r["form"] for r in lookalike.consistent_forms(df).collect()}
    assert forms[2] == forms[3] == forms[1] and forms[11] == "Москва город" and forms[9] == "" and 8 not in forms and len(forms[14]) == 200_000
    assert rows(lookalike.same_look_pairs(df)) == [(1, 2), (1, 3), (2, 10), (2, 3), (3, 10), (5, 6)]
    assert lookalike.same_look_pairs(df.where("false")).count() == 0


def test_look_needs_vocabulary(spark):
    df = spark.createDataFrame([(1, "zаz р dor"), (2, "dor de p")], "id bigint, text string")
    assert {r["id"]: r["form"] for r in lookalike.consistent_forms(df).collect()}[1] == "zаz p dor"


# -- components and splits ------------------------------------------------------------------------


@pytest.mark.parametrize("one_task", [10, 10_000])
def test_components(spark, one_task):
    random.seed(4)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges + [(None, 1)], "u bigint, v bigint")
    got = dict(rows(components.connected_components(df, one_task=one_task)))
    assert got == {x: find(x) for x in parent}


def test_linked_split(spark):
    data = [(1, 10, "5"), (2, 10, "0006"), (3, 11, " 6"), (4, 11, "7.0"), (5, 12, None), (6, 12, "0"), (7, None, "5"), (8, 13, ""), (9, None, None)]
    data += [(100 + i, 100 + i // 3, str(1000 + i // 3)) for i in range(300)]
    df = spark.createDataFrame(data, "sentenca_id bigint, doc_id bigint, cd_paciente string").withColumn("grupo", F.lit("x"))
    assert rows(linked_split.tied_patients(df)) == [(5, 6), (5, 7), (6, 7)]
    got = {r["sentenca_id"]: r for r in linked_split.linked_split(df).collect()}
    assert len(got) == len(data) and len({got[i]["particao"] for i in (1, 2, 3, 4, 7)}) == 1 and got[5]["grupo"] == got[6]["grupo"]
    n = Counter(r["particao"] for r in got.values())
    assert abs(n["treino"] / len(got) - 0.7) < 0.03 and abs(n["dev"] / len(got) - 0.15) < 0.03
    assert linked_split.tied_patients(df.where("false")).count() == 0 and linked_split.linked_split(df.where("false")).count() == 0


def test_groups_are_dealt_as_one_by_one():
    def plainly(sizes, shares):
        total, whole = sum(s * g for s, g in sizes), sum(shares.values())
        left, out = {k: total * v / whole for k, v in shares.items()}, {}
        for size, groups in sorted(sizes, reverse=True):
            got = Counter()
            for _ in range(groups):
                best = min(left, key=lambda k: (-left[k], k))
                got[best] += 1
                left[best] -= size
            out[size] = dict(got)
        return out

    random.seed(3)
    cases = [([(3, 20_000), (1, 7)], linked_split.SHARES), ([(1, 25_003)], {"a": 1.0}), ([], linked_split.SHARES)]
    cases += [([(s, random.randint(1, 60)) for s in random.sample(range(1, 90), 6)], {"a": 0.5, "b": 0.25, "c": 0.25}) for _ in range(80)]
    for sizes, shares in cases:
        assert {s: dict(x) for s, x in components.assign_groups(sizes, shares).items()} == plainly(sizes, shares)


def test_sample_is_the_first_by_hash(spark):
    df = spark.range(5000).withColumnRenamed("id", "sentenca_id")
    wanted = [r[0] for r in df.orderBy(F.xxhash64(F.lit(42), "sentenca_id"), "sentenca_id").limit(700).collect()]
    assert pii._sample(df, 700, 42)["sentenca_id"].tolist() == wanted
    assert len(pii._sample(df, 8000, 42)) == 5000 and len(pii._sample(df.where("false"), 10, 42)) == 0


# -- overlaps ----------------------------------------------------------------------------------------


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_overlaps_are_exact(spark):
    random.seed(11)
    vocab = [f"w{i}" for i in range(60)]
    base = [[random.choice(vocab) for _ in range(random.choice([24, 25, 30, 58, 66]))] for _ in range(40)]
    sents, splits = [], []
    for i in range(260):
        t = list(random.choice(base))
        for _ in range(random.randint(0, 5)):
            k = random.randrange(len(t))
            random.choice([lambda: t.pop(k), lambda: t.insert(k, random.choice(vocab)), lambda: t.__setitem__(k, "Zé")])()
        sents.append((i, [random.choice([x, x.upper()]) for x in t] + [".", None]))
        splits.append((i, random.choice(["treino", "dev", "teste", None]), "h"))
    sents += [(900, None), (901, []), (902, ["a"] * 10)]
    splits += [(900, "dev", None), (901, "treino", None), (902, "dev", None), (999, "dev", None), splits[0]]
    s = spark.createDataFrame(sents, "sentenca_id bigint, tokens array<string>")
    d = spark.createDataFrame(splits, "sentenca_id bigint, particao string, origem string")
    part = {i: p for i, p, _ in splits}
    plain = {i: [x.lower().replace("é", "e") for x in t if x and any(c.isalnum() for c in x)] for i, t in sents if t}
    wanted = set()
    for a, x in plain.items():
        for b, y in plain.items():
            if part.get(a) == "treino" and part.get(b) in ("dev", "teste") and min(len(x), len(y)) >= 24 and plain_lcs(x, y) >= 0.85 * max(len(x), len(y)) - 1e-9:
                wanted.add((a, b))
    got = {(r[0], r[1]) for r in overlap.overlaps(s, d).collect()}
    assert got == wanted and len(wanted) > 20
    ordered = [(r[0], r[1]) for r in overlap.overlap_pairs(s, d).collect()]
    assert len(ordered) == len(wanted) and set(ordered) == {(min(p), max(p)) for p in wanted}
    report = overlap.overlap_report(s, d)
    assert report.agg(F.sum("pares")).first()[0] == len(wanted)
    assert overlap.overlaps(s.where("false"), d).count() == 0


def test_lcs():
    random.seed(1)
    for _ in range(200):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 12))] for _ in range(2))
        assert overlap.common_in_order(a, b) == plain_lcs(a, b)


# -- personal information ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pii_model(spark):
    d = DATA.replace("0.001", "0.1")
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    return pii.fit(pii.training_sentences(t("sentenca"), t("anotacao_token"), t("adjudicacao_token")))


def test_redaction(spark, pii_model):
    data = [
        (1, "Avaliado por Dr. Hélio Valdevino, nega dor. Tel (27) 99999-8888 ou 3344-5566."),
        (2, "Mora em Rua das Acácias, 12, bairro Centro, CEP 29000-111, dor leve."),
        (3, "CPF: 123.456.789-00, E-mail: ana.lima(arroba)caixa ponto test, O2 @ 2 L/min, lote 12345678 conferido."),
        (4, None),
        (5, ""),
        (6, "CＰＦ １２３.456.７89-00, nega dor."),
    ]
    df = spark.createDataFrame(data, "id bigint, text string").withColumn("tipo", F.lit(1))
    done = {r["id"]: r["text"] for r in pii.redact_pii(df, pii_model).collect()}
    assert done[3] == "CPF: [DOCUMENTO], E-mail: [EMAIL], O2 @ 2 L/min, lote 12345678 conferido."
    assert done[2] == "Mora em [ENDERECO], dor leve." and done[4] is None and done[5] == ""
    assert done[6] == "CＰＦ [DOCUMENTO], nega dor." and "[TELEFONE]" in done[1]
    found = Counter(r["id"] for r in pii.find_pii(df, pii_model).collect())
    assert found[2] == 1 and found[3] == 2 and 4 not in found
    assert pii.find_pii(df.where("false"), pii_model).count() == 0


def test_names_come_from_all_sentences(spark):
    d = DATA.replace("0.001", "0.01")
    tables = [spark.read.parquet(f"{d}/{n}.parquet") for n in ("sentenca", "anotacao_token", "adjudicacao_token")]
    whole, few, sample = pii.fit(pii.training_sentences(*tables)), pii.train(*tables, most=60), pii.training_sentences(*tables, most=60)
    assert few.names == whole.names and few.common == whole.common
    assert len(sample) == 60 and len(pii.fit(sample).names) < len(whole.names)


def test_fold_keeps_places():
    for text in ("Ação Nº 5", "Ｐａｃ​iente não ﬁm", "Паz"):
        folded, where = pii_spans.fold_text(text)
        assert len(folded) == (len(text) if where is None else len(where)) and folded == folded.lower()


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    held = rng.random(600) < 0.3
    model = BoostedTrees(trees=60, depth=3).fit(x, y, held)
    test = rng.normal(size=(400, 4))
    assert (((model.chance(test) >= model.threshold).astype(int)) == ((test[:, 0] > 0) ^ (test[:, 1] > 0))).mean() > 0.9


# -- encoding ------------------------------------------------------------------------------------------


def test_encoding_is_exact(spark):
    import base64

    import tiktoken

    with open(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "<|endoftext|> fim", "a" * 30_000, "olá mundo  \n\t x" * 3000, "体温 🙂" * 900, "it's we'll 'x" * 700, "1234567890" * 500]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    for spread in (1000, 1 << 18):
        got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df, spread_chars=spread).collect()}
        assert all(got[i] == (plain.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    random.seed(8)
    for leaf_chars, leaf_bytes in ((4, 3), (16, 8)):
        coder = encode.TreeEncoder(leaf_chars=leaf_chars, leaf_bytes=leaf_bytes)
        for _ in range(300):
            t = "".join(random.choice("ab éç\n 's1.,🙂") for _ in range(random.randint(0, 120)))
            assert list(coder.encode(t)) == plain.encode_ordinary(t)
    assert encode.encode_corpus(df.where("false")).count() == 0


# -- leaks -----------------------------------------------------------------------------------------------


def test_leaks(spark):
    random.seed(5)
    vocab = [f"t{i}" for i in range(25)] + ["é", "ÇÃO"]
    items = [(i, " ".join(random.choice(vocab) for _ in range(random.randint(5, 40)))) for i in range(15)] + [(98, None), (99, "")]
    docs = []
    for i in range(60):
        w = [random.choice(vocab + ["z1", "z2"]) for _ in range(random.randint(0, 60))]
        src = random.choice(items[:15])[1].split()
        k = random.randint(0, max(0, len(src) - 1))
        w[len(w) // 2 : len(w) // 2] = src[k : k + random.randint(0, 20)]
        docs.append((i, random.choice([" ", ", ", "\n- "]).join(w).upper() if i % 2 else "; ".join(w)))
    docs += [(60, None), (61, ""), (None, items[0][1]), (5, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    t = spark.createDataFrame(items, "item_id bigint, texto string").withColumn("doc_id", F.lit("x"))
    grams = defaultdict(set)
    for i, x in items:
        w = words(x or "")
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    wanted = {(i, j) for i, x in docs if i is not None for k in range(len(words(x or "")) - 11) for j in grams.get(tuple(words(x)[k : k + 12]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in leak.phrase_matches(d, t).collect()}
    assert got == wanted and len(wanted) > 5
    assert got <= {(r["doc_id"], r["item_id"]) for r in leak.proximity_matches(d, t).collect()}
    assert leak.phrase_matches(d.where("false"), t).count() == leak.phrase_matches(d, t.where("false")).count() == 0


def plain_near(doc, item, min_words=12, slop=2):
    """Most terms of a window of item that doc holds within slop of their places, counted from a term it holds."""
    reach, best = min(min_words + slop, len(item)), 0
    for k in range(len(item) - reach + 1):
        for a in range(k, k + reach):
            for p in (p for p, x in enumerate(doc) if x == item[a]):
                best = max(best, sum(item[i] in doc[max(0, p + i - a - slop) : max(0, p + i - a + slop + 1)] for i in range(k, k + reach)))
    return best


@pytest.mark.parametrize("block", [1_000_000, 100])
def test_near_passages_are_exact(spark, block):
    random.seed(15)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, [random.choice(vocab) for _ in range(random.choice([11, 12, 13, 14, 15, 25, 40]))]) for i in range(20)]
    docs = []
    for i in range(120):
        src = items[i % 20][1]
        k = random.randint(0, max(0, len(src) - 14))
        w = list(src[k : k + random.randint(12, 15)])
        for _ in range(random.randint(0, 4)):
            j = random.randrange(len(w))
            random.choice([lambda: w.pop(j), lambda: w.insert(j, f"z{random.randint(0, 99)}"), lambda: w.__setitem__(j, f"z{random.randint(0, 99)}")])()
        if i % 10 == 0:
            w[2::4], w[3::4] = w[3::4][: len(w[2::4])] + w[2::4][len(w[3::4]) :], w[2::4][: len(w[3::4])]
        docs.append((i, [random.choice(vocab + ["y"]) for _ in range(random.randint(0, 9))] + w + [random.choice(vocab) for _ in range(random.randint(0, 9))]))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(500, None), (501, ""), (None, " ".join(items[5][1]))], "doc_id bigint, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, "")], "item_id bigint, texto string")
    wanted = {(i, j): n for i, w in docs for j, x in items if len(x) >= 12 and (n := plain_near(w, x)) >= 12}
    got = {(r["doc_id"], r["item_id"]): r["termos"] for r in leak.proximity_matches(d, t, block=block).collect()}
    exact = {(r["doc_id"], r["item_id"]) for r in leak.phrase_matches(d, t).collect()}
    assert got == wanted and exact < set(wanted) and len(set(wanted) - exact) > 20
    assert leak.proximity_matches(d.where("false"), t).count() == leak.proximity_matches(d, t.where("false")).count() == 0


# -- levels ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [2_000_000, 1])
def test_levels(spark, bound):
    random.seed(6)
    pools = {k: [f"nivel{'wxyz'[k - 1]}palavra{chr(97 + i)}" for i in range(12)] for k in range(1, 5)}
    common = ["de", "a", "que", "em", "para", "casa"]
    docs, rated = [], []
    for i in range(240):
        k = i % 4 + 1
        w = [random.choice(pools[k] + common) for _ in range(40)] + [random.choice(pools[random.randint(1, 4)]) for _ in range(6)]
        docs.append((i, " ".join(w), random.choice(["pt", "PT", None])))
        if i < 80:
            rated.append((i, 1, min(4, max(1, k + (random.random() < 0.1)))))
    docs += [(1000 + i, " ".join(random.choice(["the", "of", "and", "patient", "was", "given"]) for _ in range(30)), "en") for i in range(20)]
    docs += [(1100 + i, " ".join(random.choice(["el", "los", "paciente", "con", "y", "una"]) for _ in range(30)), "es") for i in range(20)]
    docs += [(2000, None, "pt"), (2001, "", "pt"), (2002, " 12 ", "pt"), (2003, "the of and patient was given", "pt")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("nivel", F.lit("x"))
    r = spark.createDataFrame(rated + [(5, 2, None), (None, 1, 3), (77777, 1, 2)], "doc_id bigint, avaliador int, nivel int")
    got = {x["doc_id"]: x["nivel"] for x in level.reading_levels(d, r, bound).collect()}
    assert set(got) == set(range(240))
    assert np.mean([got[i] == i % 4 + 1 for i in range(80, 240)]) > 0.97
    assert level.reading_levels(d.where("false"), r, bound).count() == 0
    assert all(x["nivel"] is None for x in level.reading_levels(d, r.where("false"), bound).collect())


def test_levels_do_not_depend_on_bound(spark):
    random.seed(16)
    pools = {k: [f"nivel{'wxyz'[k - 1]}palavra{chr(97 + i)}" for i in range(12)] for k in range(1, 5)}
    new = {k: [f"nova{'wxyz'[k - 1]}palavra{chr(97 + i)}" for i in range(12)] for k in range(1, 5)}
    docs = []
    for i in range(120):
        k = i % 4 + 1
        pool = pools[k] if i < 40 else pools[k][:3] + new[k] if i < 100 else new[k]  # only the first 40 are rated
        docs.append((i, " ".join(random.choice(pool) for _ in range(40)), "pt"))
    docs += [(i, "estranho sozinho", "pt") for i in range(200, 203)]  # linked with no rated document
    docs += [(1000 + i, " ".join(random.choice(["the", "of", "and", "patient", "was", "given"]) for _ in range(30)), "en") for i in range(20)]
    docs += [(1100 + i, " ".join(random.choice(["el", "los", "paciente", "con", "y", "una"]) for _ in range(30)), "es") for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    r = spark.createDataFrame([(i, 1, i % 4 + 1) for i in range(40)], "doc_id bigint, avaliador int, nivel int")
    kept, joined = ({x["doc_id"]: (x["theta"], x["nivel"]) for x in level.reading_levels(d, r, bound).collect()} for bound in (2_000_000, 1))
    assert set(kept) == set(joined) == {*range(120), *range(200, 203)} and kept[200] == joined[200] == (None, None)
    assert all(abs(kept[i][0] - joined[i][0]) < 1e-6 and kept[i][1] == joined[i][1] for i in range(120))
    assert np.mean([joined[i][1] == i % 4 + 1 for i in range(100, 120)]) > 0.9


# -- registration --------------------------------------------------------------------------------------------


def test_queries_are_registered():
    from garimpo.llm.queries import QUERIES
    from garimpo.llm.sql import ORACLE_SQL

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9, 10)} | {"p8_ids"} <= set(QUERIES) and set(ORACLE_SQL) <= set(QUERIES)
    assert glyphs.compat("ａ​") == "a"


def test_pii_without_training(spark):
    import pandas as pd

    model = pii.fit(pd.DataFrame({"sentenca_id": [], "tokens": [], "marks": []}))
    df = spark.createDataFrame([(1, "Dr. Fulano, CPF 123.456.789-00")], "id bigint, text string")
    assert pii.find_pii(df, model).count() == 0
    assert pii.redact_pii(df, model).first()["text"] == "Dr. Fulano, CPF 123.456.789-00"
    one = pii.fit(pd.DataFrame({"sentenca_id": [1], "tokens": [["Dr", None, "Ana"]], "marks": [None]}))
    assert pii.find_pii(df, one).count() >= 0


def test_names_joined_by_e():
    names = frozenset({"ana", "caio", "lima"})
    found = pii_spans.candidates("visita de ana lima e caio, nega dor", pii_spans.build_machine(names), names, frozenset())
    assert [(c.start, c.end, c.key[1]) for c in found if c.tipo == "PESSOA"] == [(10, 18, "visita"), (21, 25, "e")]
