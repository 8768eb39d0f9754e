"""Chat formatting after cumulative snapshots are collapsed, in DataFrame functions only.

Logs hold a conversation once for every time it was saved, each a prefix of the next.  Turns get
a rolling hash of everything up to them (128 bits, order included).  A conversation goes if its
last hash is the hash of a proper prefix of another one (an anti-join against the distinct
prefixes); of equal conversations the least conv_id stays.  What remains is rendered.

Turns are ordered by turn, null first.  Rows of one conversation that are equal in turn, role and
text are one turn; turns of one number keep an order by hash.  A null role is rendered as
``unknown``, a null text as empty, though both differ from those values when compared.  A null
conv_id is a conversation like another.  Further columns, whatever they are called, are dropped.  An empty table gives no conversations.  Texts may have any
length.  A conversation's turns meet in one task, as windows over hashes first (48 bytes a turn, which
spill) and as one row of text last; no other key gathers rows, however many conversations begin alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

COLUMNS = ("conv_id", "turn", "role", "text")
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _hashes() -> list[Column]:
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return [F.xxhash64(F.lit(k), *parts).alias(f"h{k}") for k in (1, 2)]


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, i, n (turns in all) and p1, p2, the hash of the turns up to i."""
    turns = common.only(conversations, COLUMNS).select("conv_id", "turn", *_hashes())
    # one exchange, by conversation, serves the distinct and both windows; only hashes move
    turns = turns.repartition("conv_id").dropDuplicates(["conv_id", "turn", "h1", "h2"])
    order = Window.partitionBy("conv_id").orderBy("turn", "h1", "h2")
    turns = turns.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "i", "n", *[F.bit_xor(F.xxhash64("i", "h1", "h2", F.lit(k))).over(rolling).alias(f"p{k}") for k in (1, 2)])


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another one."""
    every = prefixes(conversations)
    whole = every.where(F.col("i") == F.col("n")).groupBy("p1", "p2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = every.where(F.col("i") < F.col("n")).select("p1", "p2").distinct()
    return whole.join(proper, ["p1", "p2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def _safe(text: Column) -> Column:
    """Text that can't be taken for a mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def render(conversations: DataFrame) -> DataFrame:
    """The maximal conversations: conv_id, n_turns, n_copies, rendered."""
    kept = maximal(conversations)
    line = F.concat(F.lit(BEGIN), _safe(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), _safe(F.col("text")), F.lit(END + "\n"))
    turns = common.only(conversations, COLUMNS).select("conv_id", "turn", *_hashes(), line.alias("line"))
    same = F.col("__kept").eqNullSafe(F.col("conv_id"))
    turns = turns.join(kept.withColumnRenamed("conv_id", "__kept"), same).dropDuplicates(["conv_id", "turn", "h1", "h2"])
    parts = F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", "line")))
    return turns.groupBy("conv_id", "n_turns", "n_copies").agg(F.concat_ws("", F.transform(parts, lambda x: x["line"])).alias("rendered"))


ORACLE = f"""
with t as (select distinct conv_id, turn, role, text from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first) as i, count(*) over (partition by conv_id) as n from t),
p as (select conv_id, i, n, string_agg(coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)), chr(2)) over (partition by conv_id order by i) as h from o),
w as (select min(conv_id) as conv_id, n, h, count(*) as n_copies from p where i = n group by n, h),
k as (select * from w where not exists (select 1 from p where p.i < p.n and p.h = w.h))
select k.conv_id, k.n as n_turns, k.n_copies,
  string_agg('{BEGIN}' || replace(coalesce(o.role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(o.text, ''), '<|', '< |') || '{END}' || chr(10), '' order by o.i) as rendered
from k join o on o.conv_id is not distinct from k.conv_id group by all
"""
