"""Library tables: paging, listings, upserts, cascades, audits and state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import broadcast_checked, running_number, top_per_key


def keyset_page(df: DataFrame, key: str, cursor: str | None, limit: int) -> DataFrame:
    """The page after ``cursor``; ``next_cursor`` is set only if more rows follow.

    limit + 1 rows are taken by a distributed top-n; the surplus row only tells
    that another page exists.
    """
    rest = df if cursor is None else df.filter(F.col(key) > cursor)
    taken = rest.orderBy(key).limit(limit + 1)
    whole = W.orderBy(key)
    numbered = taken.withColumn("_n", F.row_number().over(whole)).withColumn(
        "_more", F.max("_n").over(W.partitionBy()) > limit)
    last = F.max(F.when(F.col("_n") == limit, F.col(key))).over(W.partitionBy())
    return numbered.withColumn("next_cursor", F.when(F.col("_more"), last)).filter(
        F.col("_n") <= limit).drop("_n", "_more")


def turn_pages(turns: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """For every (session_id, after_turn_id): the next turns by sequence."""
    start = turns.join(broadcast_checked(anchors), F.col("turn_id") == F.col("after_turn_id"), "left_semi").select(
        "session_id", F.col("sequence").alias("after"))
    later = turns.join(start, "session_id").filter("sequence > after").drop("after")
    return top_per_key(later, ["session_id"], [F.col("sequence")], limit, "n")


def counts_by_notebook(notebooks: DataFrame, sources: DataFrame, cap: int | None = None) -> DataFrame:
    """Number of sources of each notebook; a listing that shows no more than ``cap`` may say so."""
    counted = sources.groupBy("notebook_id").agg(F.count("*").alias("n"))
    return notebooks.join(counted, "notebook_id", "left").select(
        "notebook_id", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).alias("source_count"))


def notebook_summary(notebooks: DataFrame, insights: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """Summary parts and titled sources of every notebook as ordered rows.

    The parts stay rows with a position: a notebook may be of any size, so it is
    never folded into one value.
    """
    parts = insights.filter("insight_type = 'summary'").select(
        "notebook_id", F.lit("summary").alias("kind"), F.col("insight_id").alias("item_id"), F.col("content").alias("body"))
    listed = sources.join(versions.select("document_id", "title"), "document_id", "left").select(
        "notebook_id", F.lit("source").alias("kind"), F.col("source_id").alias("item_id"), F.col("title").alias("body"))
    ready = parts.select("notebook_id").distinct().withColumn("status", F.lit("ready"))
    rows = parts.unionByName(listed)
    return (
        notebooks.join(ready, "notebook_id", "left").join(rows, "notebook_id", "left")
        .select("notebook_id", F.coalesce("status", F.lit("empty")).alias("status"), "kind", "item_id", "body"))


def source_insights(insights: DataFrame, kind: str | None, limit: int, filter_after_paging: bool = False) -> DataFrame:
    """Insights per source; the paged form limits first and filters the page."""
    wanted = {"fact": "key_fact"}.get(kind, kind) if kind else None
    rows = insights
    if wanted and not filter_after_paging:
        rows = rows.filter(F.col("insight_type") == wanted)
    page = top_per_key(rows, ["notebook_id"], [F.col("insight_id")], limit, "n")
    if wanted and filter_after_paging:
        page = page.filter(F.col("insight_type") == wanted)
    return page


def timeline(sources: DataFrame, notes: DataFrame, sessions: DataFrame, limit: int) -> DataFrame:
    """Newest activity per notebook: sources added, notes written, sessions begun."""
    def kind(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select("notebook_id", F.col("created_at").alias("happened_at"), F.lit(name).alias("kind"), F.col(key).alias("item_id"))

    rows = kind(sources, "source_added", "source_id").unionByName(
        kind(notes, "note_created", "note_id")).unionByName(kind(sessions, "session_started", "session_id"))
    return top_per_key(rows, ["notebook_id"], [F.col("happened_at").desc(), F.col("kind"), F.col("item_id")], limit, "n")


def session_detail(sessions: DataFrame, turns: DataFrame, citations: DataFrame) -> DataFrame:
    """Turns of every session in sequence, one row per citation below its turn."""
    cited = citations.select("turn_id", "source_number", "citation_id")
    return sessions.select("session_id", "notebook_id").join(turns, "session_id").join(cited, "turn_id", "left").select(
        "session_id", "notebook_id", "sequence", "turn_id", "role", "source_number", "citation_id")


def append_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """New turns numbered on from each session's last; ``new``: session_id, arrival, role, content."""
    last = turns.groupBy("session_id").agg(F.max("sequence").alias("last"))
    numbered = running_number(new, ["session_id"], [F.col("arrival")], "_n")
    return numbered.join(last, "session_id", "left").withColumn(
        "sequence", F.coalesce(F.col("last"), F.lit(-1)) + F.col("_n")).drop("_n", "last")


def newest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; repeated keys shrink before the exchange."""
    return top_per_key(df, key, order, 1, "_n").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert or replace: the newest of the new rows wins over the stored one."""
    winners = newest(new, key, order)
    return old.join(winners.select(*key), key, "left_anti").unionByName(winners.select(old.columns))


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str], merged: str | None = None) -> DataFrame:
    """Null keeps the old value; the map column ``merged`` is merged key by key."""
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns + ([merged] if merged else [])])
    joined = old.join(renamed, key, "left")
    kept = [c for c in old.columns if c not in columns and c != merged]
    out = [F.coalesce(f"_new_{c}", c).alias(c) for c in columns]
    if merged:
        both = F.concat(
            F.filter(F.map_entries(merged), lambda e: ~F.coalesce(F.map_contains_key(f"_new_{merged}", e["key"]), F.lit(False))),
            F.coalesce(F.map_entries(f"_new_{merged}"), F.map_entries(F.create_map().cast("map<string,string>"))))
        out.append(F.map_from_entries(both).alias(merged))
    return joined.select(*kept, *out)


def cascade(tables: dict[str, DataFrame], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every dependent table without the rows of the deleted keys."""
    gone = broadcast_checked(deleted.select(key).distinct())
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def duplicate_pairs(sources: DataFrame) -> DataFrame:
    return sources.groupBy("notebook_id", "document_id").agg(F.count("*").alias("n")).filter("n > 1")


def ingest_decision(files: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """What happens to each arriving file (notebook_id, content_hash, arrival).

    A hash known in the notebook is a conflict, known elsewhere becomes a new
    source of the stored document, otherwise it is new; inside the batch the
    first arrival decides.
    """
    known = documents.groupBy("content_hash").agg(F.min("document_id").alias("document_id"))
    held = sources.join(documents.select("document_id", "content_hash"), "document_id").select(
        "notebook_id", "content_hash").distinct().withColumn("held", F.lit(True))
    in_batch = files.groupBy("content_hash").agg(F.min("arrival").alias("first_arrival"))
    in_notebook = files.groupBy("notebook_id", "content_hash").agg(F.min("arrival").alias("first_here"))
    joined = (
        files.join(known, "content_hash", "left").join(held, ["notebook_id", "content_hash"], "left")
        .join(in_batch, "content_hash").join(in_notebook, ["notebook_id", "content_hash"]))
    decision = (
        F.when(F.col("held") | (F.col("arrival") > F.col("first_here")), "conflict")
        .when(F.col("document_id").isNotNull() | (F.col("arrival") > F.col("first_arrival")), "new_source")
        .otherwise("new_document"))
    return joined.select(
        "notebook_id", "content_hash", "arrival", decision.alias("decision"),
        F.coalesce("document_id", X.uuid5(F.concat(F.lit("document:"), "content_hash"))).alias("document_id"))


def version_violations(documents: DataFrame, versions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Broken invariants: current version, unique hashes, times, contiguous ordinals."""
    current = documents.join(
        versions.select("document_id", "version_id", F.col("content_hash").alias("vh")),
        ["document_id", "version_id"], "left")
    missing = current.filter("vh is null").select("document_id", F.lit("no current version").alias("problem"))
    disagree = current.filter("vh <> content_hash").select("document_id", F.lit("hash differs").alias("problem"))
    times = documents.filter("created_at > updated_at").select("document_id", F.lit("created after updated").alias("problem"))
    repeated = versions.groupBy("document_id", "content_hash").agg(F.count("*").alias("n")).filter("n > 1").select(
        "document_id", F.lit("repeated hash").alias("problem"))
    gaps = blocks.groupBy("document_id").agg(
        F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count("*").alias("n"), F.count_distinct("ordinal").alias("u")
    ).filter("lo <> 0 or hi + 1 <> n or u <> n").select("document_id", F.lit("ordinals not contiguous").alias("problem"))
    return missing.unionByName(disagree).unionByName(times).unionByName(repeated).unionByName(gaps)


def source_listing(sources: DataFrame, versions: DataFrame) -> DataFrame:
    info = versions.select("document_id", "status", "content_hash", "doc_type", "n_chars")
    return sources.join(info, "document_id", "left").select(
        "source_id", "notebook_id", "document_id",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce("doc_type", F.lit("generic")).alias("doc_type"),
        F.coalesce("n_chars", F.lit(0)).alias("size"))


def lookup(keys: DataFrame, key: str, table: DataFrame, children: DataFrame, child_key: str) -> DataFrame:
    """Rows of the asked keys, one per child, children by age."""
    asked = broadcast_checked(keys.select(key).distinct())
    found = table.join(asked, key)
    return found.join(children, child_key, "left")


def orphans(tables: dict[str, DataFrame], owners: DataFrame, key: str) -> DataFrame:
    """Rows of each derived table whose owner is gone, as counts."""
    known = owners.select(key).distinct()
    parts = [
        df.join(known, key, "left_anti").groupBy().agg(F.count("*").alias("orphans")).withColumn("table_name", F.lit(name))
        for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def request_fingerprint(fields: list[str]) -> Column:
    """SHA-256 of the canonical JSON of the named columns in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def dedup_requests(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Per request: new, replay of a stored result, or conflict on its id."""
    known = stored.select("request_id", F.col("fingerprint").alias("stored_fingerprint"))
    return requests.join(known, "request_id", "left").withColumn(
        "outcome",
        F.when(F.col("stored_fingerprint").isNull(), "new")
        .when(F.col("stored_fingerprint") == F.col("fingerprint"), "replay").otherwise("conflict"))


def transition_states(states: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare-and-set: one move per execution wins where the expected state holds.

    ``moves``: execution_id, expected, target, arrival. Returns the new states and
    every move with its verdict.
    """
    joined = moves.join(states.select("execution_id", "state"), "execution_id", "left")
    fits = joined.withColumn("fits", F.col("state").isNotNull() & (F.col("state") == F.col("expected")))
    winner = fits.filter("fits").groupBy("execution_id").agg(
        F.min(F.struct("arrival", "target")).alias("w")).select(
        "execution_id", F.col("w.arrival").alias("won"), F.col("w.target").alias("won_target"))
    verdicts = fits.join(winner, "execution_id", "left").select(
        "execution_id", "expected", "target", "arrival",
        F.when(F.col("fits") & (F.col("arrival") == F.col("won")), "applied").otherwise("lost").alias("verdict"))
    after = states.join(winner, "execution_id", "left").withColumn(
        "state", F.coalesce("won_target", "state")).drop("won", "won_target")
    return after, verdicts


def append_snapshots(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append-only by (execution_id, phase): first arrival is kept, the rest conflict."""
    key = ["execution_id", "phase"]
    fresh = incoming.join(stored.select(*key), key, "left_anti")
    accepted = newest(fresh, key, [F.col("arrival")])
    refused = incoming.join(accepted.select(*key, "arrival"), [*key, "arrival"], "left_anti")
    return stored.unionByName(accepted.select(stored.columns)), refused


def ir_conflicts(parsed: DataFrame) -> DataFrame:
    """Versions for which different content was offered."""
    return parsed.groupBy("version_id").agg(F.count_distinct("digest").alias("digests")).filter("digests > 1")


def asset_rows(contents: DataFrame) -> DataFrame:
    """Content-addressed assets: one row per hash, id derived from it."""
    hashed = contents.withColumn("content_hash", F.sha2("content", 256))
    kept = newest(hashed, ["content_hash"], [F.col("arrival")])
    return kept.select(
        "content_hash", X.uuid5(F.concat(F.lit("asset:"), "content_hash")).alias("asset_id"), "arrival",
        F.length("content").alias("size"))


def upsert_chunks(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk upsert by id; versions whose batch repeats an id are refused whole."""
    repeated = batch.groupBy("version_id", "chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "version_id").distinct()
    good = batch.join(repeated, "version_id", "left_anti")
    merged = stored.join(good.select("chunk_id"), "chunk_id", "left_anti").unionByName(good.select(stored.columns))
    return merged, repeated


def write_chunk_tables(chunks: DataFrame, filters: DataFrame, titles: DataFrame, folder: str) -> None:
    """The chunk sink: chunks by version and position, filter and title tables beside them."""
    tables = {"chunks": (chunks, ["version_id", "ordinal"]), "chunk_filters": (filters, ["document_id"]), "chunk_titles": (titles, ["chunk_id"])}
    for name, (df, order) in tables.items():
        df.repartition(order[0]).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/{name}")
