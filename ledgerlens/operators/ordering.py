"""Latest-of, top-n, paging, conversation trims and upload admission.

Rank filters are written as ``row_number() <= n``. Up to
``spark.sql.optimizer.windowGroupLimitThreshold`` Spark prunes each map task to n
rows per key before the shuffle (WindowGroupLimit); beyond it ``first_n`` ranks
parts of a key first. A hot key therefore never reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import constants as K
from ledgerlens.functions.skew import ranked


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str] | None = None
) -> DataFrame:
    """The row with the greatest ``order`` per key, combined map side."""
    payload = list(payload) if payload is not None else [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
            rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key along ``order``.

    A large ``n`` is not pruned by Spark, so each key is cut into parts by a hash
    of the row, and only the first ``n`` of every part meet.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(parts))
        inside = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_in_part", F.row_number().over(inside)).filter(
            F.col("_in_part") <= n).drop("_part", "_in_part")
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with ``total`` and ``has_more``; planned as TakeOrdered, not a full sort."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("total", total).withColumn(
        "has_more", F.col("total") > F.lit(offset + limit)
    )


def page_after(df: DataFrame, keys: Sequence[tuple[str, bool]], limit: int, after: Sequence | None = None) -> DataFrame:
    """The ``limit`` rows that follow a row with the key values ``after``.

    ``keys`` are (column, descending) and make the order total; nulls come first
    ascending and last descending, as in a sort. However deep the page, a task
    keeps ``limit`` rows.
    """
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (name, falls), value in zip(keys, after, strict=True):
            column, at = F.col(name), F.lit(value)
            if value is None:
                step = F.lit(False) if falls else column.isNotNull()
            else:
                step = F.coalesce(column < at, F.lit(True)) if falls else F.coalesce(column > at, F.lit(False))
            beyond, equal = beyond | (equal & step), equal & column.eqNullSafe(at)
        df = df.filter(beyond)
    return df.orderBy(*[F.desc(n) if falls else F.asc(n) for n, falls in keys]).limit(limit)


def recent_per_org(df: DataFrame, org: str, ts: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` newest rows of each organisation, ranked from 1."""
    return first_n(df, [org], [F.desc(ts), F.desc(key)], n, "recent_rank")


def number_items(df: DataFrame, array: str, line: str = "line_number", item: str = "item") -> DataFrame:
    """Array elements as rows numbered from 1."""
    kept = [c for c in df.columns if c != array]
    return df.select(*kept, F.posexplode(array).alias("_pos", item)).withColumn(
        line, F.col("_pos") + 1
    ).drop("_pos")


def trim_history(
    msgs: DataFrame, session: str, turn: str, role: str = "role", keep: int = K.HISTORY_MAX
) -> DataFrame:
    """At most ``keep`` messages per session; a leading system message survives."""
    lead = msgs.groupBy(session).agg(
        F.min(turn).alias("_first"), F.min_by(role, turn).alias("_lead")
    )
    newest = first_n(msgs, [session], [F.desc(turn)], keep, "_back")
    marked = newest.join(lead, session)
    # the first message replaces the oldest kept one when it is a system message
    system = F.col("_lead") == "system"
    tail = marked.filter(~(system & (F.col("_back") == keep) & (F.col(turn) != F.col("_first"))))
    head = (
        msgs.filter(F.col(role) == "system")
        .join(lead.select(session, F.col("_first").alias(turn)), [session, turn], "left_semi")
        .join(tail.select(session, turn), [session, turn], "left_anti")
    )
    return tail.select(*msgs.columns).unionByName(head.select(*msgs.columns))


def digest(msgs: DataFrame, session: str, turn: str, role: str = "role", text: str = "text",
           last: int = K.DIGEST_MESSAGES) -> DataFrame:
    """One text per session: its last messages, shortened, one line each."""
    speaker = F.when(F.col(role) == "user", "User: ").when(F.col(role) == "assistant", "AI: ")
    line = F.concat(speaker, F.substring(text, 1, K.DIGEST_CHARS), F.lit("..."))
    lines = (
        first_n(msgs, [session], [F.desc(turn)], last)
        .withColumn("_line", line).filter(F.col("_line").isNotNull())
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col("_line"))))
    return lines.groupBy(session).agg(
        F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n").alias("digest")
    )


def user_context(summaries: DataFrame, user: str = "user_id", created: str = "created_at",
                 key: str = "session_id", limit: int = 3) -> DataFrame:
    """Context text per user from the newest summaries and their topics."""
    topics = F.when(
        F.size("key_topics") > 0, F.array_join(F.slice("key_topics", 1, 3), ", ")
    ).otherwise("general")
    line = F.concat(F.lit("- ["), topics, F.lit("] "), F.substring("summary", 1, 200))
    lines = first_n(summaries, [user], [F.desc(created), F.desc(key)], limit, "_rank")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_rank"), line.alias("_line"))))
    text = F.concat_ws(
        "\n", F.lit("Relevant context from previous conversations:"),
        F.transform(ordered, lambda x: x["_line"]),
    )
    return lines.groupBy(user).agg(text.alias("context"))


def admit_uploads(
    events: DataFrame, keys: Sequence[str], file: str, ts: str, key: str,
    cap: int = K.MAX_FOLDER_DOCUMENTS,
) -> DataFrame:
    """Uploads with ``action``: added, limit_exceeded, or exists for a repeat.

    The first ``cap`` distinct files of a job are added. A refused file is not
    registered, so its repeats are refused again.
    """
    order = F.struct(F.col(ts), F.col(key))
    firsts = events.groupBy(*keys, file).agg(F.min(order).alias("_first"))
    admitted = first_n(firsts, keys, [F.col("_first")], cap).withColumn("_in", F.lit(True))
    action = (
        F.when(F.col("_in").isNull(), "limit_exceeded")
        .when(order == F.col("_first"), "added").otherwise("exists")
    )
    return (
        events.join(admitted, [*keys, file], "left").withColumn("action", action)
        .drop("_first", "_in")
    )


def safe_name(name: Column) -> Column:
    """Spaces to underscores, other odd characters dropped."""
    cleaned = F.regexp_replace(F.regexp_replace(name, " ", "_"), r"(?U)[^\p{L}\p{N}_.\-]", "")
    return F.when(cleaned == "", "unnamed_file").otherwise(cleaned)


def dedupe_names(
    files: DataFrame, folder: str, name: str, order: Sequence[Column], bucket: Column,
    out: str = "stored_name",
) -> DataFrame:
    """Distinct stored names per folder: the second ``a.csv`` becomes ``a_1.csv``.

    Names are handed out in arrival order as the upload loop would: a copy takes
    the lowest free suffix. Only when a name like ``a_1.csv`` also arrives as
    such can suffixes clash; those name families are settled in a second pass.
    """
    split = r"^(.+?)(\.[^.]*)?$"
    base = F.regexp_extract(name, split, 1)
    ext = F.regexp_extract(name, split, 2)
    seq = ranked(files, [folder, name], order, bucket, "_copy")
    wanted = F.when(F.col("_copy") == 1, F.col(name)).otherwise(
        F.concat(base, F.lit("_"), (F.col("_copy") - 1).cast("string"), ext)
    )
    first_pass = seq.withColumn(out, wanted)
    # names that could be produced as copies of another arriving name
    stem = F.regexp_replace(base, r"(_\d+)+$", "")
    marked = first_pass.withColumn("_family", F.concat(stem, ext)).withColumn(
        "_suffixed", stem != base
    )
    clashing = (
        marked.groupBy(folder, "_family")
        .agg(F.max("_suffixed").alias("_s"), F.max(F.col("_copy") > 1).alias("_c"))
        .filter(F.col("_s") & F.col("_c")).select(folder, "_family")
    )
    calm = marked.join(clashing, [folder, "_family"], "left_anti")
    rough = marked.join(clashing, [folder, "_family"], "left_semi")
    return calm.select(*files.columns, out).unionByName(
        _hand_out(rough, files, folder, name, order, out)
    )


def _hand_out(rough: DataFrame, files: DataFrame, folder: str, name: str,
              order: Sequence[Column], out: str) -> DataFrame:
    """Replay the naming loop for the clashing families, streamed in arrival order."""
    import os

    columns = files.columns
    schema = files.select("*", F.col(name).alias(out)).schema
    at = columns.index(folder), columns.index(name)

    def replay(batches):
        import pandas as pd

        family, taken, nexts = None, set(), {}
        for pdf in batches:
            names = []
            for where, wanted, group in zip(pdf[columns[at[0]]], pdf[columns[at[1]]], pdf["_family"]):
                if (where, group) != family:
                    family, taken, nexts = (where, group), set(), {}
                given = wanted
                if given in taken:
                    base, ext = os.path.splitext(wanted)
                    n = nexts.get(wanted, 1)
                    while f"{base}_{n}{ext}" in taken:
                        n += 1
                    nexts[wanted] = n + 1
                    given = f"{base}_{n}{ext}"
                taken.add(given)
                names.append(given)
            yield pdf[columns].assign(**{out: pd.Series(names, index=pdf.index, dtype=object)})

    lined_up = rough.repartition(folder, "_family").sortWithinPartitions(folder, "_family", *order)
    return lined_up.select(*columns, "_family").mapInPandas(replay, schema)


def ready_jobs(docs: DataFrame, job: str, created: str, now: Column,
               delay: int = K.QUIET_SECONDS, min_docs: int = 1) -> DataFrame:
    """Jobs with enough documents whose last upload is older than the delay."""
    jobs = docs.groupBy(job).agg(
        F.count(F.lit(1)).alias("document_count"), F.max(created).alias("last_upload")
    ).filter(F.col("document_count") >= min_docs)
    if delay <= 0:
        return jobs
    return jobs.filter(F.col("last_upload") < now - F.make_interval(secs=F.lit(delay)))
