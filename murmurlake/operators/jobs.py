"""Jobs, actions and folders: listing, search, moves, upserts, the action overview, folder roll-ups."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTION = "struct<text:string,done:boolean,assignee:string,due:string>"


def listing(jobs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row for each job with counts of its actions, whether it has notes and the bytes of its files; newest first."""
    out = jobs.select(
        "id", "title", "category", "updated_at", F.coalesce(F.size("actions"), F.lit(0)).alias("n_actions"),
        F.coalesce(F.size(F.filter("actions", lambda a: a.done)), F.lit(0)).alias("n_done"), (F.coalesce(F.trim("notes"), F.lit("")) != "").alias("has_notes"),
    )
    if sizes is not None:
        out = out.join(sizes.groupBy("id").agg(F.sum("bytes").alias("bytes")), "id", "left").fillna(0, ["bytes"])
    return out.orderBy(F.col("updated_at").desc(), "id")


def recent(jobs: DataFrame, n: int = 6) -> DataFrame:
    """The n newest jobs (a report's limit)."""
    return jobs.orderBy(F.col("updated_at").desc(), "id").limit(n)


#: Where a search looks: plain fields, and fields of lists.
FIELDS = ("title", "category", "summary", "source_text", "notes", "followup")
LISTED = {"actions": ("text", "assignee"), "participants": ("name", "role"), "utterances": ("text",)}


def matching(jobs: DataFrame, query: str) -> DataFrame:
    """Jobs one of whose FIELDS, or of the fields LISTED, contains the trimmed, lower-cased query; all for a blank one. Columns that a
    table does not have are not searched."""
    q = query.strip().lower()
    if not q:
        return jobs
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    hit = F.lit(False)
    for f in FIELDS:
        if f in jobs.columns:
            hit = hit | has(F.col(f))
    for f, names in LISTED.items():
        if f in jobs.columns:
            hit = hit | F.coalesce(F.exists(f, lambda x: reduce(or_, [has(x[n]) for n in names])), F.lit(False))  # noqa: B023
    return jobs.where(hit)


def from_stored(stored: DataFrame) -> DataFrame:
    """Jobs as they are stored (readers.read_jobs) under the names that these operators use."""
    names = {"jobType": "job_type", "createdAt": "created_at", "updatedAt": "updated_at", "summaryDraft": "summary", "sourceText": "source_text", "audioPath": "audio_path", "micWavPath": "mic_wav_path", "mixWavPath": "mix_wav_path", "transcriptionPending": "transcription_pending"}
    out = stored.withColumnsRenamed(names)
    return out.withColumn("utterances", F.col("transcript.utterances")) if "transcript" in out.columns else out


def renamed(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """jobs with title and category of `new` (id, title, category); updated_at stays, so the order of the history does too."""
    meta = new.select("id", F.struct("title", "category").alias("_m"))
    rows = jobs.join(meta, "id", "left").withColumns({c: F.when(F.col("_m").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(c)) for c in ("title", "category")})
    return rows.select(*jobs.columns)


AUDIO = ("audio_path", "mic_wav_path", "mix_wav_path")


def without_audio(jobs: DataFrame, ids: DataFrame | None = None, own_folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """jobs with no audio paths where their id is in ids (id), or in all; and the files (path) that may be deleted: those below own_folder,
    the rest are the user's."""
    hit = F.lit(True)
    rows = jobs
    if ids is not None:
        rows = jobs.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
        hit = F.coalesce(F.col("_hit"), F.lit(False))
    gone = rows.where(hit).select(F.explode(F.array(*AUDIO)).alias("path")).where(F.col("path").startswith(own_folder.rstrip("/") + "/") if own_folder else F.lit(False)).distinct()
    return rows.withColumns({c: F.when(~hit, F.col(c)) for c in AUDIO}).select(*jobs.columns), gone


def deleted(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """jobs, or tasks, without those of ids (id); ids that are gone already change nothing."""
    return jobs.join(ids.select("id"), "id", "left_anti")


def moved_jobs(jobs: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """jobs with those of ids (id) in another folder, trimmed; nothing else changes."""
    rows = jobs.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return rows.withColumn("category", F.when(F.col("_hit"), folder.strip()).otherwise(F.col("category"))).select(*jobs.columns)


def added_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    return tasks.unionByName(new)


def updated_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """tasks with whole rows of `new` in place of those of the same id; an id that tasks has not changes nothing."""
    return tasks.join(new.select("id"), "id", "left_anti").unionByName(new.join(tasks.select("id"), "id", "left_semi"))


def moved(path: Column, source: str, target: str) -> Column:
    """A folder's new path when `source` becomes `target`; only whole path parts count, an empty target is the root."""
    a, b = source.strip("/"), target.strip("/")
    if not a or a == b:
        return path
    tail = F.substr(path, F.lit(len(a) + 2))
    return F.when(path == a, F.lit(b)).when(F.startswith(path, F.lit(a + "/")), F.concat(F.lit(b + "/"), tail) if b else tail).otherwise(path)


def upserted(jobs: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """jobs with rows of `new` in place of those of the same id; a blank new category keeps the stored one."""
    old = jobs.select(key, F.col("category").alias("_old"))
    kept = new.join(old, key, "left").withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), "_old")).drop("_old")
    return jobs.join(new.select(key), key, "left_anti").unionByName(kept)


def all_actions(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs' actions with their index, and tasks that belong to no job."""
    own = jobs.select(F.col("id").alias("job_id"), F.col("title").alias("project"), "category", F.posexplode("actions").alias("idx", "a"))
    own = own.select("job_id", "idx", "project", "category", "a.text", "a.done", "a.assignee", "a.due")
    return own.unionByName(tasks.select(F.lit(None).cast(own.schema["job_id"].dataType).alias("job_id"), F.col("id").cast("int").alias("idx"), F.lit("Fristående").alias("project"), "category", "text", "done", "assignee", "due"))


def with_action(actions: Column, idx: int, **fields) -> Column:
    """The list with the given fields of one action replaced; an index outside the list is an error."""
    def change(a: Column) -> Column:
        for name, value in fields.items():
            a = a.withField(name, F.lit(value))
        return a

    inside = (F.coalesce(F.size(actions), F.lit(0)) > idx) & F.lit(idx >= 0)
    return F.when(inside, F.transform(actions, lambda a, i: F.when(i == idx, change(a)).otherwise(a))).otherwise(F.raise_error(F.lit(f"there is no action {idx}")))


def with_added_action(actions: Column, text: str, done: bool = False, assignee: str = "", due: str = "") -> Column:
    new = F.struct(F.lit(text).alias("text"), F.lit(done).alias("done"), F.lit(assignee).alias("assignee"), F.lit(due).alias("due")).cast(ACTION)
    return F.array_append(F.coalesce(actions, F.array().cast(f"array<{ACTION}>")), new)


def without_action(actions: Column, idx: int) -> Column:
    """The list without one action; an index outside it changes nothing."""
    return F.filter(actions, lambda a, i: i != idx)


def action_set(jobs: DataFrame, id_: object, idx: int, now: str, **fields) -> DataFrame:
    """jobs with one action of one job changed and its updated_at set."""
    return _one(jobs, id_, lambda a: with_action(a, idx, **fields), now)


def action_added(jobs: DataFrame, id_: object, now: str, **action) -> DataFrame:
    return _one(jobs, id_, lambda a: with_added_action(a, **action), now)


def action_deleted(jobs: DataFrame, id_: object, idx: int, now: str) -> DataFrame:
    """jobs without one action of one job; where there is none of that index updated_at stays too."""
    return _one(jobs, id_, lambda a: without_action(a, idx), now, (F.coalesce(F.size("actions"), F.lit(0)) > idx) & F.lit(idx >= 0))


def _one(jobs: DataFrame, id_: object, change, now: str, test: Column | None = None) -> DataFrame:
    hit = (F.col("id") == id_) & (F.lit(True) if test is None else test)
    return jobs.withColumns({"actions": F.when(hit, change(F.col("actions"))).otherwise(F.col("actions")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def due_state(due: Column, today: Column) -> Column:
    """none, text, overdue, today, soon (within seven days) or future."""
    day = F.when(due.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(due, "yyyy-MM-dd"))
    left = F.date_diff(day, today)
    blank = F.coalesce(F.trim(due), F.lit("")) == ""
    return F.when(blank, "none").when(day.isNull(), "text").when(left < 0, "overdue").when(left == 0, "today").when(left <= 7, "soon").otherwise("future")


def action_counts(actions: DataFrame, today: Column) -> DataFrame:
    late = ~F.col("done") & (due_state(F.col("due"), today) == "overdue")
    return actions.agg(F.count_if(~F.col("done")).alias("n_open"), F.count_if(late).alias("n_overdue"), F.count_if("done").alias("n_done"), F.count("*").alias("n_total"))


def project_name(job_id: Column, title: Column) -> Column:
    """What a task without a job and a job without a title are called."""
    return F.when(job_id.isNull(), "Fristående").otherwise(F.coalesce(F.nullif(title, F.lit("")), F.lit("Namnlöst")))


def row_key(job_id: Column, idx: Column, task_id: Column) -> Column:
    return F.when(job_id.isNull(), F.concat(F.lit("t:"), task_id.cast("string"))).otherwise(F.concat(F.lit("j:"), job_id.cast("string"), F.lit(":"), idx.cast("string")))


def filtered_actions(actions: DataFrame, today: Column, status: str = "all", assignee: str = "", folder: str = "", due: str = "all", query: str = "") -> DataFrame:
    """Actions by status (open, done), assignee, folder and all below it, due class (overdue, week, none) and a text found in text,
    assignee or project; the defaults keep everything."""
    state = due_state(F.col("due"), today)
    rows = actions
    if status != "all":
        rows = rows.where(F.col("done") if status == "done" else ~F.col("done"))
    if assignee:
        rows = rows.where(F.trim("assignee") == assignee)
    if folder:
        path = F.regexp_replace(F.trim("category"), "^/+|/+$", "")
        rows = rows.where((path == folder) | path.startswith(folder + "/"))
    if due != "all":
        rows = rows.where(state.isin(*{"overdue": ("overdue",), "week": ("today", "soon"), "none": ("none", "text")}[due]))
    if q := query.strip().lower():
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", text("text"), text("assignee"), text("project"))), F.lit(q)))
    return rows


#: Fixed value: the group of actions that nobody answers for.
NOBODY = "Utan ansvarig"


def grouped_actions(actions: DataFrame, by: str = "assignee", missing: str = NOBODY, slots: int = 64) -> DataFrame:
    """actions plus `grp` and `nth`, the place within the group by (job_id, idx, text) from 0; by: assignee, project, or flat for one group.

    A group may be most rows and is never gathered: its rows are ranked in slices of its order, dealt by range, and shifted by the
    sizes of the slices before.
    """
    grp = F.lit("") if by == "flat" else F.coalesce(F.nullif(F.trim(by), F.lit("")), F.lit(missing))
    order = [F.col("grp"), F.col("job_id").asc_nulls_first(), F.col("idx").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = actions.withColumn("grp", grp).repartitionByRange(slots, *order).withColumn("_slice", F.spark_partition_id())
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("grp", "_slice").orderBy(*order[1:])))
    sizes = rows.groupBy("grp", "_slice").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("grp").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("grp", "_slice", before.alias("_before")), ["grp", "_slice"]).withColumn("nth", F.col("_before") + F.col("_n") - 1).drop("_slice", "_n", "_before")


def group_heads(actions: DataFrame, by: str = "assignee", missing: str = NOBODY) -> DataFrame:
    """(grp, n) of each group, in Swedish order."""
    grp = F.coalesce(F.nullif(F.trim(by), F.lit("")), F.lit(missing))
    return actions.groupBy(grp.alias("grp")).agg(F.count("*").alias("n")).orderBy(F.collate("grp", "sv"))


def parent_of(path: Column) -> Column:
    """The path without its last part; empty for one part."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def rewritten_pending(pending: DataFrame, source: str, target: str) -> DataFrame:
    """Empty folders (folder) under their new paths, as moved() gives them; blank ones go."""
    return pending.select(moved(F.col("folder"), source, target).alias("folder")).where("folder <> ''")


def jobs_in_folder(jobs: DataFrame, folder: str) -> DataFrame:
    """Jobs of a folder and of all below it; all for a blank one."""
    return jobs.where((F.col("category") == folder) | F.col("category").startswith(folder + "/")) if folder else jobs


def categories(jobs: DataFrame) -> DataFrame:
    """(category): distinct, not blank, by code unit."""
    return jobs.where("category <> ''").select("category").distinct().orderBy("category")


def total_bytes(jobs: DataFrame, size: str = "bytes") -> DataFrame:
    return jobs.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def job_by_id(jobs: DataFrame, id_: object) -> DataFrame:
    """The job of an id; none of that id is an error, at once."""
    hit = jobs.where(F.col("id") == id_)
    if hit.isEmpty():
        raise ValueError(f"there is no job {id_}")
    return hit


def path_parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")


def ancestors(path: Column) -> Column:
    """Every prefix of a path, itself included."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def folder_rollup(jobs: DataFrame, path: str = "category", size: str | None = None) -> DataFrame:
    """(folder, n, bytes) over each folder and all below it. Counts are made by path first, so ancestors are exploded per path."""
    each = jobs.groupBy(path).agg(F.count("*").alias("n"), F.sum(size or F.lit(0)).cast("long").alias("bytes"))
    return each.select(F.explode(ancestors(F.col(path))).alias("folder"), "n", "bytes").groupBy("folder").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def folder_tree(folders: DataFrame) -> DataFrame:
    """(folder) to (folder, depth, has_children)."""
    parents = folders.select(F.regexp_replace("folder", "/?[^/]*$", "").alias("folder")).where("folder <> ''").distinct().withColumn("has_children", F.lit(True))
    return folders.join(parents, "folder", "left").select("folder", F.size(F.split("folder", "/")).alias("depth"), F.coalesce("has_children", F.lit(False)).alias("has_children"))


def pending_folders(pending: DataFrame, real: DataFrame) -> DataFrame:
    return pending.select("folder").join(real.select("folder"), "folder", "left_anti").distinct()


def due_key(done: Column, due: Column) -> Column:
    """Sorts open before done, dated before undated, dates ascending."""
    t = F.coalesce(F.trim(due), F.lit(""))
    return F.concat(F.when(done, "1").otherwise("0"), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit("1"), t)).otherwise("2"))


def sorted_actions(actions: DataFrame, by: str = "due") -> DataFrame:
    """By due date then project, by project then due date (both in Swedish order), or newest first; ids break ties."""
    due, project = due_key(F.col("done"), F.col("due")), F.collate("project", "sv")
    keys = {"due": (due, project), "project": (project, due), "updated": (F.col("updated_at").desc_nulls_last(),)}[by]
    return actions.orderBy(*keys, "job_id", "idx")


def assignees(actions: DataFrame) -> DataFrame:
    """(assignee): trimmed, not blank, distinct, in Swedish order."""
    return actions.select(F.trim("assignee").alias("assignee")).where("assignee <> ''").distinct().orderBy(F.collate("assignee", "sv"))


def visible_folders(tree: DataFrame, expanded: list[str]) -> DataFrame:
    """Rows of folder_tree whose ancestors are all expanded."""
    above = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.array_join(F.slice(F.split("folder", "/"), 1, i), "/"))
    open_ = F.array(*[F.lit(e) for e in expanded]).cast("array<string>")
    return tree.where(F.forall(F.slice(above, 1, F.col("depth") - 1), lambda a: F.array_contains(open_, a)))


def finished_meetings(done: DataFrame, stored: DataFrame, snapshots: DataFrame) -> DataFrame:
    """done (id, transcript, audio_path) with the workspace of the stored job, or, if none is stored, of the snapshot.

    A whole row is chosen, so that a field cleared in the stored job stays cleared. Meetings with neither are left out.
    """
    fields = [c for c in stored.columns if c not in ("id", "transcript", "audio_path")]
    pack = lambda df, name: df.select("id", F.struct(*fields, F.col("audio_path").alias("_a")).alias(name))
    rows = done.join(pack(stored, "s"), "id", "left").join(pack(snapshots, "n"), "id", "left").withColumn("w", F.coalesce("s", "n")).where("w IS NOT NULL")
    return rows.select("id", "transcript", F.coalesce("audio_path", "w._a").alias("audio_path"), *[F.col(f"w.{c}").alias(c) for c in fields])


def unique_name(taken: set[str], base: str = "Ny mapp") -> str:
    """base, or base and the first free number from 2."""
    name, n = base, 2
    while name in taken:
        name, n = f"{base} {n}", n + 1
    return name


def summary_text(summary: Column, transcript: Column | None = None) -> Column:
    return summary if transcript is None else F.concat(summary, F.lit("\n\n## Transkript\n\n"), transcript)
