"""Message threads: components, reply parents, cycles, keys, order and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import cut, running_number

REPLY_LINE = r"(?i)^(?:-{2,}\s*(?:original message|forwarded message)\s*-{2,}|on .+ wrote:)\s*$"


def links(messages: DataFrame) -> DataFrame:
    """Directed (parent, child) identifier pairs: references in a row, reply to message."""
    chain = F.arrays_zip(F.slice("refs", 1, F.greatest(F.size("refs") - 1, F.lit(0))).alias("parent"),
                         F.slice("refs", 2, F.greatest(F.size("refs") - 1, F.lit(0))).alias("child"))
    inner = X.unfold(messages, [], chain, "p").select("p.parent", "p.child")
    parent = F.coalesce("in_reply_to", F.try_element_at("refs", F.lit(-1)))
    outer = messages.select(parent.alias("parent"), F.col("message_id").alias("child")).filter(
        "parent is not null and child is not null")
    return inner.unionByName(outer)


def identifiers(messages: DataFrame) -> DataFrame:
    """(id, source_index, pos) of every mention: references, then reply, then own id."""
    mentioned = F.filter(
        F.concat("refs", F.array("in_reply_to"), F.array("message_id")), lambda x: x.isNotNull())
    return X.unfold(messages, ["source_index"], mentioned, "id", "pos")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least identifier reachable over undirected edges.

    Each round takes the least label among the neighbours and then follows the
    label of that label, so chains shrink by jumps; labels are checkpointed. A hub
    only ever meets one label row, and minima combine before the exchange.
    """
    both = edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).filter("a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a"), "left").select(
            "id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        roots = hooked.select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = cut(hooked.join(roots, "component", "left").select(
            "id", F.least("component", "next").alias("component"), "before"))
        labels = jumped.select("id", "component")
        if jumped.filter("component <> before").isEmpty():
            return labels


def reply_parents(messages: DataFrame) -> DataFrame:
    """Parent message: the first named id that occurs, if it is unique and not the message itself."""
    named = F.filter(F.concat(F.array("in_reply_to"), F.reverse("refs")), lambda x: x.isNotNull())
    rows = X.unfold(messages, ["source_index"], named, "id", "pos")
    seen = messages.filter("message_id is not null").groupBy(F.col("message_id").alias("id")).agg(
        F.count("*").alias("times"), F.min("source_index").alias("target"))
    first = rows.join(seen, "id").groupBy("source_index").agg(F.min_by(F.struct("times", "target"), "pos").alias("hit"))
    parent = F.when((F.col("hit.times") == 1) & (F.col("hit.target") != F.col("source_index")), F.col("hit.target"))
    return messages.select("source_index").join(first, "source_index", "left").select("source_index", parent.alias("parent"))


def cycle_members(parents: DataFrame) -> DataFrame:
    """Messages on a reply cycle, by doubling parent pointers.

    After enough doublings the set of targets is exactly the set of cycle members;
    it is complete once it no longer shrinks.
    """
    jumps = cut(parents.select("source_index", F.col("parent").alias("up")).filter("up is not null"))
    size = -1
    while True:
        targets = jumps.select(F.col("up").alias("source_index")).distinct()
        count = targets.count()
        if count in (0, size):
            return targets
        size = count
        step = jumps.select(F.col("source_index").alias("up"), F.col("up").alias("far"))
        jumps = cut(jumps.join(step, "up").select("source_index", F.col("far").alias("up")))


def thread_keys(messages: DataFrame, prefix: str = "email-thread-v1:") -> DataFrame:
    """(source_index, thread_key): SHA-256 of prefix and the seed of the component.

    Seed: the first mentioned identifier without a parent, else the least one.
    """
    mentions = identifiers(messages)
    nodes = mentions.groupBy("id").agg(F.min(F.struct("source_index", "pos")).alias("first_seen"))
    edges = links(messages)
    labelled = components(nodes.select("id"), edges)
    children = edges.filter("parent <> child").select(F.col("child").alias("id")).distinct().withColumn("child", F.lit(True))
    known = labelled.join(nodes, "id").join(children, "id", "left")
    seeds = known.groupBy("component").agg(
        F.min_by("id", F.when(F.col("child").isNull(), F.col("first_seen"))).alias("root"), F.min("id").alias("least")
    ).select("component", F.sha2(F.concat(F.lit(prefix), F.coalesce("root", "least")), 256).alias("thread_key"))
    anchor = mentions.groupBy("source_index").agg(F.min_by("id", "pos").alias("id"))
    keyed = anchor.join(labelled, "id").join(seeds, "component").select("source_index", "thread_key")
    bare = F.sha2(F.concat(F.lit(prefix), F.lit("raw-sha256:"), F.sha2("body", 256)), 256)
    return messages.select("source_index", bare.alias("_bare")).join(keyed, "source_index", "left").select(
        "source_index", F.coalesce("thread_key", "_bare").alias("thread_key"))


def order_keys(parents: DataFrame) -> DataFrame:
    """(source_index, order_key): sorting by key gives parents first, smallest index first.

    Taking the smallest ready index again and again visits a message right after
    the latest of its ancestors, and so on below that one. The key of a message is
    therefore the descending chain of maxima on its path from the root, read from
    the end. Two path pieces combine, so keys are built by doubling parent
    pointers; where replies follow their parents a key has a single entry. A cycle
    among the parents is an error: after as many doublings as the number of messages
    has bits, every path has reached its root.
    """
    state = cut(parents.select("source_index", F.col("parent").alias("up"), F.array("source_index").alias("order_key")))
    for _ in range(state.count().bit_length() + 1):
        if state.filter("up is not null").isEmpty():
            return state.select("source_index", "order_key")
        above = state.select(F.col("source_index").alias("up"), F.col("up").alias("far"), F.col("order_key").alias("head"))
        state = cut(state.join(above, "up", "left").select(
            "source_index", F.col("far").alias("up"),
            F.when(F.col("head").isNull(), F.col("order_key")).otherwise(F.concat(
                F.filter("head", lambda x: x > F.get("order_key", F.lit(0))), "order_key")).alias("order_key")))
    if state.filter("up is not null").isEmpty():
        return state.select("source_index", "order_key")
    raise ValueError("replies form a cycle; see cycle_members")


def thread_order(messages: DataFrame) -> DataFrame:
    """Position of every message in its thread; threads by their first message."""
    raw = cut(reply_parents(messages))
    cyclic = cycle_members(raw).withColumn("cyclic", F.lit(True))
    parents = raw.join(cyclic, "source_index", "left").select(
        "source_index", F.when(F.col("cyclic").isNull(), F.col("parent")).alias("parent"))
    keyed = thread_keys(messages).join(order_keys(parents), "source_index").join(parents, "source_index")
    first = keyed.groupBy("thread_key").agg(F.min("source_index").alias("thread_first"))
    return running_number(keyed.join(first, "thread_key"), ["thread_first", "thread_key"], [F.col("order_key")], "position")


def split_regions(messages: DataFrame) -> DataFrame:
    """Body, quoted and signature runs of plain bodies (message_id, body)."""
    rows = X.unfold(messages, ["message_id"], F.split("body", "\n"), "line", "n")
    line = W.partitionBy("message_id").orderBy("n")
    bare = F.regexp_replace("line", r"\r$", "")
    signed = F.max((bare == "-- ").cast("int")).over(line) == 1
    answered = F.max((F.rlike(X.strip(bare), F.lit(REPLY_LINE))).cast("int"))
    quoted = F.coalesce(answered.over(line) == 1, F.lit(False)) | F.startswith(F.ltrim("line"), F.lit(">"))
    marked = rows.withColumn("region", F.when(signed, "signature").when(quoted, "quoted").otherwise("body"))
    starts = marked.withColumn("new", (~F.col("region").eqNullSafe(F.lag("region").over(line))).cast("int"))
    grouped = starts.withColumn("run", F.sum("new").over(line)).groupBy("message_id", "run", "region").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return grouped.withColumn("text", X.strip(F.col("text"))).filter("text <> ''")
