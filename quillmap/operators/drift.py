"""Schemas that drift between files: tree edit scripts, and the projections they compile to.

A file's schema is the tree of its member paths. The trees of successive files are aligned by the cheapest edit script of
adding, removing, renaming and moving nodes (see ``trees``); members whose values agree on the records both files hold may
be the same. The scripts of a stream compose to one projection for each file: old path to last name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions.jsontext import canonical
from quillmap.operators.shred import _KINDS, parse_record
from quillmap.operators.trees import edit_script
from quillmap.session import stage, unstage

FILE = ["stream", "file_name", "written_at"]
_PAIR = ["stream", "before", "later"]


def leaves(record: dict) -> Iterator[tuple[str, str, str | None]]:
    """``path, kind, value`` of every member, objects included; arrays aren't entered. Numbers have one form by value."""
    stack = [("", record)]
    while stack:
        prefix, obj = stack.pop()
        for name, v in obj.items():
            kind = _KINDS[type(v)]
            if kind == "object":
                yield prefix + name, kind, None
                stack.append((f"{prefix}{name}.", v))
            else:
                yield prefix + name, kind, canonical(v)


def _fields(lines: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys)


def member_rows(lines: DataFrame, keys: list[str], body: str = "body", run: str = "run_dir", only: str | None = None) -> DataFrame:
    """``keys..., run, path, kind, value``: a row for each member of each whole line; other lines have none.

    ``only``: a column of paths, other members are left out.
    """
    n = len(keys)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, runs, rows = [], [], []
            wanted = batch.column(n + 1).to_pylist() if only else None
            for k, text in enumerate(batch.column(n).to_pylist()):
                record = parse_record(text, wrappers=())
                if record is None:
                    continue
                found = list(leaves(record))
                if wanted is not None:
                    mine = set(wanted[k])
                    found = [x for x in found if x[0] in mine]
                rows += found
                at += [k] * len(found)
                runs += [canonical(record.get(run))] * len(found)
            index = pa.array(at, pa.int64())
            own = [pa.array(c, pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 3
            yield pa.record_batch([*[batch.column(c).take(index) for c in range(n)], pa.array(runs, pa.string()), *own], names=[*keys, "run", "path", "kind", "value"])

    source = lines.select(*keys, F.col(body).alias("_body"), *([only] if only else []))
    return source.mapInArrow(parse, f"{_fields(lines, keys)}, run string, path string, kind string, value string")


def schemas(lines: DataFrame, body: str = "body") -> DataFrame:
    """``stream, file_name, written_at, path, kinds``: the paths of each file and the kinds of their non-null values.

    Paths are counted once a batch before they are shuffled; values leave no task.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            files = [batch.column(c).to_pylist() for c in range(2)] + [batch.column(2).cast(pa.int64()).to_pylist()]
            for k, (text, *file) in enumerate(zip(batch.column(3).to_pylist(), *files)):
                record = parse_record(text, wrappers=())
                if record is not None:
                    for path, kind in _paths(record):
                        seen.setdefault((*file, path, kind), k)
            index = pa.array(list(seen.values()), pa.int64())
            own = [pa.array([x[c] for x in seen], pa.string()) for c in (3, 4)]
            yield pa.record_batch([*[batch.column(c).take(index) for c in range(3)], *own], names=[*FILE, "path", "kind"])

    found = lines.select(*FILE, F.col(body).alias("_body")).mapInArrow(parse, f"{_fields(lines, FILE)}, path string, kind string")
    return found.groupBy(*FILE, "path").agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("kinds"))


def _paths(record: dict) -> Iterator[tuple[str, str]]:
    stack = [("", record)]
    while stack:
        prefix, obj = stack.pop()
        for name, v in obj.items():
            kind = _KINDS[type(v)]
            yield prefix + name, kind
            if kind == "object":
                stack.append((f"{prefix}{name}.", v))


def successions(schema: DataFrame) -> DataFrame:
    """``stream, file_name, before, later``: each file with the one written before it in its stream; none for the first."""
    files = schema.select(*FILE).distinct()
    order = Window.partitionBy("stream").orderBy("written_at", "file_name")
    me = F.struct("written_at", "file_name")
    return files.select("stream", F.lag(me).over(order).alias("before"), me.alias("later")).where(F.col("before").isNotNull())


def differences(schema: DataFrame, pairs: DataFrame) -> DataFrame:
    """``stream, before, later, path, old, new``: the kinds of every path in both files of a pair; null where it is not."""
    one = schema.select("stream", F.struct("written_at", "file_name").alias("file"), "path", "kinds")
    as_new = one.join(pairs.withColumn("file", F.col("later")), ["stream", "file"]).select("stream", "before", "later", "path", F.lit(None).cast("array<string>").alias("old"), F.col("kinds").alias("new"))
    as_old = one.join(pairs.withColumn("file", F.col("before")), ["stream", "file"]).select("stream", "before", "later", "path", F.col("kinds").alias("old"), F.lit(None).cast("array<string>").alias("new"))
    return as_new.unionByName(as_old).groupBy("stream", "before", "later", "path").agg(F.max("old").alias("old"), F.max("new").alias("new"))


def agreements(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """``stream, before, later, old_path, new_path``: members of which the new one holds the old one's values.

    For the runs in both files, wherever neither is missing or null, kind and value must be equal, at least once, and no
    value may be an object. Only the values of changed members are read, of pairs of files where some came and some went.
    """
    both = changed.groupBy(*_PAIR).agg(F.sum(F.col("new").isNull().cast("int")).alias("gone"), F.sum(F.col("old").isNull().cast("int")).alias("came"))
    able = changed.join(both.where("gone > 0 AND came > 0").select(*_PAIR), _PAIR, "left_semi")
    asked = able.where("old IS NULL OR new IS NULL").select("stream", F.when(F.col("new").isNull(), F.col("before")).otherwise(F.col("later")).alias("file"), "path")
    wanted = asked.groupBy("stream", F.col("file.file_name").alias("file_name"), F.col("file.written_at").alias("written_at")).agg(F.collect_set("path").alias("wanted"))
    values = member_rows(lines.join(wanted, FILE), FILE, only="wanted").where((F.col("kind") != "null") & F.col("run").isNotNull()).distinct()
    values = stage(values.select("stream", F.struct("written_at", "file_name").alias("file"), "run", "path", "kind", "value"), "values")
    side = lambda end, other, x: values.join(able.where(F.col(other).isNull()).withColumn("file", F.col(end)).select(*_PAIR, "file", "path"), ["stream", "file", "path"]).select(*_PAIR, "run", F.col("path").alias(f"{x}_path"), F.col("kind").alias(f"{x}_kind"), F.col("value").alias(f"{x}_value"))
    same = (F.col("old_kind") == F.col("new_kind")) & (F.col("old_kind") != "object") & F.coalesce(F.col("old_value") == F.col("new_value"), F.lit(False))
    met = side("before", "new", "old").join(side("later", "old", "new"), [*_PAIR, "run"]).groupBy(*_PAIR, "old_path", "new_path").agg(F.min(same).alias("all"))
    return met.where("all").select(*_PAIR, "old_path", "new_path")


def _scripts(trees: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (nodes, agree) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                old = {x["path"]: x["old"] for x in nodes if x["old"] is not None}
                new = {x["path"]: x["new"] for x in nodes if x["new"] is not None}
                steps = edit_script(old, new, [(x["old_path"], x["new_path"]) for x in agree or ()])
                rows += steps
                at += [k] * len(steps)
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            own = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
            yield pa.record_batch([*[batch.column(c).take(pa.array(at, pa.int64())) for c in range(3)], *own], names=[*_PAIR, "step", "old_path", "new_path", "cost", "leaf"])

    return trees.mapInArrow(run, f"{_fields(trees, _PAIR)}, step string, old_path string, new_path string, cost double, leaf boolean")


def edit_scripts(lines: DataFrame) -> DataFrame:
    """``stream, before, later, step, old_path, new_path, cost, leaf`` for every file and the one written before it.

    The cheapest script of each pair of files, by ``trees.edit_script``; one row of a pair's changed paths and agreements
    is a task's unit, its size that of two schemas. Unchanged paths are left out. An agreement the one-to-one script
    doesn't use is reported as ``alike``. Lines delivered twice change nothing; files without a whole line are not in the
    series; a file name written at two times is two files. Columns other than those of FILE and ``body`` are ignored.
    """
    schema = stage(schemas(lines), "schemas")
    changed = stage(differences(schema, successions(schema)).where("old IS NULL OR new IS NULL OR (size(old) > 0 AND size(new) > 0 AND old != new)"), "changed")
    links = agreements(lines, changed).groupBy(*_PAIR).agg(F.collect_list(F.struct("old_path", "new_path")).alias("agree"))
    nodes = changed.groupBy(*_PAIR).agg(F.collect_list(F.struct("path", "old", "new")).alias("nodes"))
    return _scripts(nodes.join(links, _PAIR, "left").select(*_PAIR, "nodes", "agree"))


def changes(lines: DataFrame) -> DataFrame:
    """``file_name, change_kind, old_path, new_path``: each later file's differences, read off the scripts.

    A leaf that is renamed, moved, carried or alike is renamed here; an object never is, so one that a script maps is a
    path removed and another added. Leaves that are alike to others are neither added nor removed.
    """
    scripts = stage(edit_scripts(lines), "scripts")
    name, none = F.col("later.file_name").alias("file_name"), F.lit("")
    mapped = F.col("step").isin("renamed", "moved", "carried", "alike")
    renamed = scripts.where(mapped & F.col("leaf")).select(name, F.lit("renamed").alias("change_kind"), "old_path", "new_path")
    alike = scripts.where("step = 'alike'")
    left = scripts.where("step IN ('added', 'removed')").join(alike.select(*_PAIR, F.lit("added").alias("step"), F.col("new_path")).distinct(), [*_PAIR, "step", "new_path"], "left_anti")
    left = left.join(alike.select(*_PAIR, F.lit("removed").alias("step"), F.col("old_path")).distinct(), [*_PAIR, "step", "old_path"], "left_anti")
    alone = left.select(name, F.col("step").alias("change_kind"), "old_path", "new_path")
    retyped = scripts.where("step = 'retyped'").select(name, F.lit("retyped").alias("change_kind"), "old_path", "new_path")
    objects = scripts.where(mapped & ~F.col("leaf"))
    both = objects.select(name, F.lit("removed").alias("change_kind"), "old_path", none.alias("new_path")).unionByName(objects.select(name, F.lit("added").alias("change_kind"), none.alias("old_path"), "new_path"))
    return renamed.unionByName(alone).unionByName(retyped).unionByName(both)


def final_names(scripts: DataFrame) -> DataFrame:
    """``stream, at, path, name``: each rename's old path, the last file that has it, and what it is called in the end.

    Every rename points at the next one of the name it gives; pointers are doubled until none moves, so the number of
    joins grows with the logarithm of the longest chain and no task holds a stream.
    """
    renames = scripts.where(F.col("step").isin("renamed", "moved", "carried"))
    events = stage(renames.select("stream", F.col("before").alias("at"), F.col("old_path").alias("path"), F.col("later").alias("since"), F.col("new_path").alias("name")), "renames")
    # In the order of a path's files, an arrival's next departure is the first rename of the path at or after its file.
    arrivals = events.select("stream", F.col("name").alias("p"), F.col("since").alias("t"), F.struct("at", "path").alias("arrival"), F.lit(None).cast(events.select(F.struct("at", "path").alias("x")).schema["x"].dataType).alias("departure"), F.lit(0).alias("kind"))
    leaving = events.select("stream", F.col("path").alias("p"), F.col("at").alias("t"), F.lit(None).cast(events.select(F.struct("at", "path").alias("x")).schema["x"].dataType).alias("arrival"), F.struct("at", "path").alias("departure"), F.lit(1).alias("kind"))
    after = Window.partitionBy("stream", "p").orderBy("t", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    linked = arrivals.unionByName(leaving).withColumn("next", F.first("departure", True).over(after)).where("arrival IS NOT NULL").select("stream", F.col("arrival").alias("me"), "next")
    state = events.select("stream", F.struct("at", "path").alias("me"), "name").join(linked, ["stream", "me"], "left")
    held = None
    while True:
        state = stage(state.select("stream", "me", "name", "next"), "names")
        if held is not None:
            unstage(held)
        held = state
        if not state.where("next IS NOT NULL").head(1):
            break
        ahead = state.select("stream", F.col("me").alias("next"), F.col("name").alias("_name"), F.col("next").alias("_next"))
        state = state.join(ahead, ["stream", "next"], "left").select("stream", "me", F.coalesce("_name", "name").alias("name"), F.col("_next").alias("next"))
    return state.select("stream", F.col("me.at").alias("at"), F.col("me.path").alias("path"), "name")


def projections(members: DataFrame, scripts: DataFrame) -> DataFrame:
    """``stream, written_at, file_name, path, name``: for each file the paths that are called otherwise in the end.

    A path of a file takes the first rename at or after the file.
    """
    at = F.struct("written_at", "file_name")
    has = members.select("stream", "path", at.alias("t")).distinct()
    events = final_names(scripts).select("stream", "path", F.col("at").alias("t"), "name")
    both = has.withColumns({"name": F.lit(None).cast("string"), "kind": F.lit(0)}).unionByName(events.withColumn("kind", F.lit(1)))
    after = Window.partitionBy("stream", "path").orderBy("t", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    named = both.withColumn("name", F.first("name", True).over(after)).where("kind = 0 AND name IS NOT NULL")
    return named.select("stream", F.col("t.written_at").alias("written_at"), F.col("t.file_name").alias("file_name"), "path", "name")


def consistent(members: DataFrame, scripts: DataFrame) -> DataFrame:
    """The members of all files under their last names: ``name`` beside the columns of ``members``.

    The projections, a row for each renamed path of a file, are joined to the members. Values stay text with their kind,
    so a member whose type changes keeps all its values.
    """
    renamed = projections(members, scripts)
    return members.join(renamed, [*FILE, "path"], "left").withColumn("name", F.coalesce("name", "path"))


def wide_table(named: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row for each line with a text column for each name."""
    value = F.when(F.col("kind") != "object", F.col("value"))
    return named.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n.replace(".", "__")) for n in names])
