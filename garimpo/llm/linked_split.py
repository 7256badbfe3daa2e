"""Train, dev and test splits in which tied records stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions.fold import patient_number
from garimpo.llm.components import assign_groups, connected_components, pairs_within, star_edges
from garimpo.ranking import permuted_rank
from garimpo.shared import materialize

#: Shares of the reference's design.
SHARES = {"treino": 0.70, "dev": 0.15, "teste": 0.15}


def patient_components(sentences: DataFrame) -> DataFrame:
    """(patient, component): patients tied directly or by chains of documents.

    sentences: doc_id, cd_paciente; other columns are ignored. Patients are the numbers
    that cd_paciente spells; null, blank, 0 and anything without a number are unknown and
    tie nothing; a null doc_id ties nothing. Only patients that share a document occur in
    the edges, so a table without ties gives no rows.
    """
    links = sentences.select("doc_id", patient_number(F.col("cd_paciente")).alias("_patient"))
    comps = connected_components(star_edges(links, "doc_id", "_patient"))
    return comps.select(F.col("node").alias("patient"), "component")


def tied_patients(sentences: DataFrame) -> DataFrame:
    """Pairs (cd_paciente_a < cd_paciente_b) of patients that must share a split."""
    pairs = pairs_within(patient_components(sentences), "patient", "component")
    return pairs.select(F.col("a").alias("cd_paciente_a"), F.col("b").alias("cd_paciente_b"))


def linked_split(sentences: DataFrame, shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(sentenca_id, grupo, particao): every sentence, all of a doc_id and of a patient in one split.

    A group is the component of the document's patients, else (no known patient) the
    document, else (null doc_id) the patient or the sentence itself. Groups go
    largest-first to the split furthest below its share; groups of equal size are told
    apart by a seeded hash rank. Repeated sentences keep their rows. Only the histogram
    of group sizes reaches the driver.
    """
    shares = shares or SHARES
    base = sentences.select("sentenca_id", "doc_id", patient_number(F.col("cd_paciente")).alias("_patient"))
    comp = patient_components(sentences).select(F.col("patient").alias("_node"), F.col("component").alias("_comp"))
    firsts = base.where("doc_id is not null and _patient is not null").groupBy("doc_id").agg(F.min("_patient").alias("_first"))
    tied = firsts.join(comp, F.col("_first") == F.col("_node"), "left").select("doc_id", F.coalesce("_comp", "_first").alias("_docgroup"))
    own = comp.withColumnsRenamed({"_node": "_pnode", "_comp": "_pcomp"})
    # Sentences without doc_id are looked up by patient; a hot patient's rows meet one row, which is broadcast or skew-split.
    grouped = (
        base.join(tied, "doc_id", "left")
        .join(own, F.col("_patient") == F.col("_pnode"), "left")
        .select(
            "sentenca_id",
            F.when(F.col("_docgroup").isNotNull(), F.concat(F.lit("p"), "_docgroup"))
            .when(F.col("_patient").isNotNull(), F.concat(F.lit("p"), F.coalesce("_pcomp", "_patient")))
            .when(F.col("doc_id").isNotNull(), F.concat(F.lit("d"), "doc_id"))
            .otherwise(F.concat(F.lit("s"), F.coalesce(F.col("sentenca_id").cast("string"), F.lit("null"))))
            .alias("grupo"),
        )
    )
    grouped = materialize(grouped, "grouped")
    sizes = grouped.groupBy("grupo").agg(F.count(F.lit(1)).alias("_size"))
    histogram = [(int(r["_size"]), int(r["n"])) for r in sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()]
    spark = sentences.sparkSession
    slots = []
    for size, dealt in assign_groups(histogram, shares).items():
        upto = 0
        for split, n in dealt:
            slots.append((size, upto + 1, upto + n, split))
            upto += n
    places = spark.createDataFrame(slots or [(0, 0, 0, "")], "_sz bigint, _from bigint, _to bigint, particao string")
    ranked = permuted_rank(sizes, ["_size"], F.xxhash64(F.lit(seed), "grupo"), "_rank")
    dealt = ranked.join(places, (F.col("_size") == F.col("_sz")) & F.col("_rank").between(F.col("_from"), F.col("_to"))).select("grupo", "particao")
    return grouped.join(dealt, "grupo").select("sentenca_id", "grupo", "particao")
