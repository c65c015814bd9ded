"""Patch replies: reading, guarding, applying; borrowed sentences; rejected replies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.functions.jsonfix import read_patches
from palimp.functions.text import breaks_dash, is_no_changes, join_markers, plain_text
from palimp.functions.xhtml import well_formed
from palimp.plans.durable import durable

#: A sentence of at least so many characters proves a mix-up when it turns up in another paragraph.
BORROWED = 40


def read_replies(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, outcome, patches)`` per reply: ``patches`` (array of (p, text), in order), ``no_changes`` or
    ``rejected``. A null reply is rejected; a patch without a number or text, or with a number that is
    no integer, rejects the reply; an empty array changes nothing."""
    named = replies.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.coalesce(is_no_changes(F.col(text_col)), F.lit(False)).alias("_none"))
    kind = named.schema["_id"].dataType.simpleString()

    def one(text, none):
        if text is None:
            return "rejected", []
        if none:
            return "no_changes", []
        try:
            value = read_patches(text)
            return ("patches" if value else "no_changes"), [{"p": int(x["p"]), "text": str(x["text"]).strip(), "ok": well_formed(str(x["text"]).strip())} for x in value if x["p"] is not None and x["text"] is not None or _fail()]
        except (ValueError, TypeError, KeyError, RecursionError):
            return "rejected", []

    def run(batches):
        for batch in batches:
            out = [one(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            patch = pa.list_(pa.struct([("p", pa.int32()), ("text", pa.string()), ("ok", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], patch)], names=[id_col, "outcome", "patches"])

    return named.mapInArrow(run, f"{id_col} {kind}, outcome string, patches array<struct<p:int,text:string,ok:boolean>>")


def _fail():
    raise ValueError("patch without number or text")


def apply_patches(read: DataFrame, paragraphs: DataFrame, id_col: str) -> DataFrame:
    """``(id, p, before, after, verdict)``: one row per patch of every readable reply.

    ``paragraphs`` has ``(id, p, text)``. A number outside the paragraphs rejects its whole reply
    (verdict ``out_of_range``). Of the rest a patch is refused if it breaks a dialogue dash, is not
    well formed, or carries a long sentence of another paragraph that its own lacks; the last accepted
    patch of a paragraph wins (``applied``), earlier ones are ``overridden``."""
    patches = read.filter("outcome = 'patches'").select(id_col, F.posexplode("patches").alias("at", "x")).select(id_col, "at", "x.p", F.col("x.text").alias("after"), "x.ok")
    texts = paragraphs.select(id_col, "p", F.col("text").alias("before"))
    sizes = paragraphs.groupBy(id_col).agg(F.max("p").alias("n"))
    joined = durable(patches.join(sizes, id_col).join(texts, [id_col, "p"], "left"))
    bad = joined.withColumn("_bad", ~F.col("p").between(1, F.col("n"))).groupBy(id_col).agg(F.max("_bad").alias("_bad"))
    taken = borrowed(joined.select(id_col, "at", "p", "after", "before"), paragraphs, id_col).select(id_col, "at").distinct().withColumn("_taken", F.lit(True))
    judged = joined.join(bad, id_col).join(taken, [id_col, "at"], "left")
    verdict = (
        F.when(F.col("_bad"), "out_of_range").when(breaks_dash(F.col("before"), F.col("after")), "dash").when(~F.col("ok"), "malformed").when(F.col("_taken"), "borrowed").otherwise("accepted")
    )
    judged = judged.withColumn("verdict", verdict)
    last = judged.filter("verdict = 'accepted'").groupBy(id_col, "p").agg(F.max("at").alias("_last"))
    final = F.when(F.col("verdict") != "accepted", F.col("verdict")).when(F.col("at") == F.col("_last"), "applied").otherwise("overridden")
    return judged.join(last, [id_col, "p"], "left").select(id_col, "at", "p", "before", "after", final.alias("verdict"))


def patched(read: DataFrame, paragraphs: DataFrame, id_col: str) -> DataFrame:
    """``(id, outcome, changed, paragraphs, text)`` for every reply of ``read`` that has paragraphs: its text
    after the patches, with markers. ``outcome`` is that of the reply, or ``out_of_range`` where a patch's
    number is outside; both that and ``rejected`` have no text. Without patches the text is unchanged."""
    applied = apply_patches(read, paragraphs, id_col)
    bad = applied.filter("verdict = 'out_of_range'").select(id_col).distinct().withColumn("_bad", F.lit(True))
    made = applied.filter("verdict = 'applied'").select(id_col, "p", F.col("after").alias("_after"))
    now = paragraphs.join(made, [id_col, "p"], "left").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("_after", "text").alias("text")))).alias("_ps"), F.max(F.coalesce(F.col("_after") != F.col("text"), F.lit(False))).alias("_changed"))
    joined = read.select(id_col, "outcome").join(now, id_col).join(bad, id_col, "left")
    outcome = F.when(F.col("_bad"), "out_of_range").otherwise(F.col("outcome"))
    kept = lambda c: F.when(outcome.isin("patches", "no_changes"), c)
    texts = F.transform("_ps", lambda x: x["text"])
    return joined.select(id_col, outcome.alias("outcome"), kept(F.col("_changed")).alias("changed"), kept(texts).alias("paragraphs"), kept(join_markers(texts)).alias("text"))


def borrowed(patches: DataFrame, paragraphs: DataFrame, id_col: str) -> DataFrame:
    """Patches ``(id, at, p, after, before)`` with a sentence of ``BORROWED`` characters or more of another
    paragraph of the same reply that their own lacks. The sentences of a reply meet its patches on an
    equi-join; containment is checked on what meets."""
    sentences = paragraphs.select(id_col, F.col("p").alias("_other"), F.explode(F.split(plain_text(F.col("text")), r"(?<=[.!?…»])\s+")).alias("_s")).filter(F.length("_s") >= BORROWED)
    mine = patches.withColumn("_a", plain_text(F.col("after"))).withColumn("_b", plain_text(F.col("before")))
    return mine.join(sentences, id_col).filter("_other <> p and contains(_a, _s) and not coalesce(contains(_b, _s), false)").select(id_col, "at", "p", F.col("_other").alias("other"))

