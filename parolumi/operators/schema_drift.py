"""Fields that drift between the files of successive runs.

Every JSON file's leaf paths are read in parallel, counted by run, folded through a
type lattice (boolean, number < string) into one schema, and compared run by run.
A path that ends while another under the same parent begins and holds values alike is
a renamed field; likeness is measured on histograms of the values.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from parolumi.session import written

_FIELDS = "run_dir string, run_no int, file_id bigint, fields array<struct<path:string,kind:string,place:double>>"
_CELLS = "run_dir string, run_no int, path string, bin string, n bigint"
#: Changed runs and their paths of up to so many bytes in all are sent to all executors to select files.
BROADCAST_BYTES = 4 << 20
#: Column and type of what has no column of its own.
OTHERS = ("other_fields", "map<string,array<string>>")
_NUMBER = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` by sorting both. Left to itself Spark would broadcast a written
    table by the size of its compressed files, of which the driver holds many times as much."""
    return a.join(b.hint("merge"), on, how)


def leaves(value, path: str = "", place: float = 0.0) -> Iterator[tuple[str, str | None, object, float]]:
    """(path, kind, value, place among its siblings) of every leaf; `.` between names,
    `[]` after an array; kind is string, number, boolean or None for null. Empty objects
    and arrays have no leaves."""
    if isinstance(value, dict):
        for i, (k, v) in enumerate(value.items()):
            yield from leaves(v, f"{path}.{k}" if path else k, i / max(1, len(value)))
    elif isinstance(value, list):
        for v in value:
            yield from leaves(v, path + "[]", place)
    else:
        kind = None if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        yield path, kind, value, place


@lru_cache(100_000)
def script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0]


@lru_cache(100_000)
def sign(ch: str) -> str:
    return "9" if ch.isdigit() else script(ch)[:4].lower() if ch.isalpha() else " " if ch.isspace() else ch


def shape(text: str) -> str:
    """The pattern of a string: runs of letters by script, of digits, other signs as
    they are, repeated words as one."""
    out: list[str] = []
    for ch in text:
        c = sign(ch)
        if not out or out[-1] != c:
            out.append(c)
    return re.sub(r"\b([a-z]{4}|9)(?:,? \1)+\b", r"\1+", " ".join("" if c == " " else c for c in out).replace("  ", " "))


def outline(text: str) -> str:
    """A coarser pattern: of three or more words the script of most letters, else the kind
    of each word, with what follows the last full stop in a word of mixed signs, such
    as a file's ending."""
    words = text.split()
    if len(words) >= 3:
        scripts = Counter(script(c) for c in text if c.isalpha())
        return "text " + max(sorted(scripts), key=scripts.get).lower() if scripts else "text"
    out: list[str] = []
    for word in words:
        core = word.strip(".,:;!?…։«»\"'()")
        scripts = {unicodedata.name(c, "?").split(" ")[0] for c in core if c.isalpha()}
        kind = "9" if not scripts else scripts.pop().lower() if core.isalpha() and len(scripts) == 1 else "mixed"
        if kind == "mixed" and (ending := re.search(r"\.([a-z][a-z0-9]{0,4})$", core)):
            kind += "." + ending[1]
        out.append(kind)
    return " ".join(out)


def value_bins(kind: str | None, value) -> list[str]:
    """The histogram cells a value falls in: magnitude and wholeness of numbers (of
    strings that are numbers, too), truth, exact value and pattern of strings."""
    if kind is None:
        return []
    if kind == "boolean":
        return ["b"]
    if kind == "number" or _NUMBER.match(value.strip()):
        x = float(value)
        size = 0 if x == 0 else int(abs(x).hex().split("p")[1]) if abs(x) < float("inf") else 9999
        return [f"m{'-' if x < 0 else '+'}{size}", "i" if x == int(x) else "f"] if abs(x) < float("inf") else ["m?", "f"]
    return [f"v{xxhash.xxh64_hexdigest(value)}", f"s{shape(value)}", f"o{outline(value)}"]


def _parsed(bodies) -> Iterator[tuple[int, object]]:
    """(position, document) of the bodies that parse."""
    for i, b in enumerate(bodies):
        try:
            yield i, json.loads(b)
        except (TypeError, ValueError, RecursionError):
            continue


def file_fields(files: DataFrame) -> DataFrame:
    """The leaf paths of every file that parses: each with its kinds and its place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at, fields = [], []
            for i, doc in _parsed(f["body"]):
                found: dict[tuple, float] = {}
                for path, kind, _, place in leaves(doc):
                    found.setdefault((path, kind), place)
                at.append(i)
                fields.append([{"path": p, "kind": k, "place": x} for (p, k), x in found.items()])
            yield f[["run_dir", "run_no", "file_id"]].iloc[at].reset_index(drop=True).assign(fields=pd.Series(fields, dtype=object))

    return files.mapInPandas(run, _FIELDS)


def value_cells(files: DataFrame) -> DataFrame:
    """Histogram cells of the ``paths`` asked of each file, counted by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cells: dict[tuple, int] = {}
            for i, doc in _parsed(f["body"]):
                asked, d, n = set(f["paths"].iloc[i]), f["run_dir"].iloc[i], int(f["run_no"].iloc[i])
                for path, kind, value, _ in leaves(doc):
                    if path in asked:
                        for cell in value_bins(kind, value):
                            k = (d, n, path, cell)
                            cells[k] = cells.get(k, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in cells.items()], columns=["run_dir", "run_no", "path", "bin", "n"])

    return files.select("run_dir", "run_no", "body", "paths").mapInPandas(run, _CELLS).groupBy("run_dir", "run_no", "path", "bin").agg(F.sum("n").alias("n"))


class Drift:
    """Run-level tables of a set of files, written once and read by what follows.

    ``fields``: run_dir, run_no, path, kind (of most of the files that have a value there;
    null if none has), files, parsable, held (more than half of the run's parsable files hold
    it).

    Files given twice count once; bodies that are null or don't parse are left out, as are
    rows with a null folder, run or id. Empty tables give no changes and no columns.
    Values are read again only in the runs and of the paths that may have been renamed.
    """

    def __init__(self, files: DataFrame, file_id: str = "file_id", run_dir: str = "run_dir", run_no: str = "run_no", body: str = "body"):
        kept = files.select(F.col(run_dir).cast("string").alias("run_dir"), F.col(run_no).cast("int").alias("run_no"), F.col(file_id).cast("bigint").alias("file_id"), F.col(body).cast("string").alias("body"))
        self.files = kept.where("run_dir is not null and run_no is not null and file_id is not null and body is not null")
        by_file = written(file_fields(self.files).dropDuplicates(["file_id", "run_dir", "run_no"]), "file-fields")
        key = ["run_dir", "run_no"]
        self.parsable = by_file.groupBy(*key).agg(F.count("*").alias("parsable"))
        paths = by_file.select(*key, F.explode("fields").alias("f")).select(*key, "f.*")
        # a path with values of two kinds in one file counts once: the null kind stands first
        per_file = by_file.select(*key, F.explode(F.array_distinct(F.transform("fields", lambda x: x["path"]))).alias("path"))
        holders = per_file.groupBy(*key, "path").agg(F.count("*").alias("files"))
        kinds = paths.groupBy(*key, "path", "kind").agg(F.count("*").alias("files"), F.avg("place").alias("place"))
        kind = kinds.groupBy(*key, "path").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("files", "kind"))).alias("kind"), F.avg("place").alias("place"))
        fields = _joined(_joined(holders, kind, [*key, "path"]), self.parsable, key)
        self.fields = written(fields.withColumn("held", F.col("files") * 2 > F.col("parsable")), "run-fields")

    def changes(self, least_likeness: float = 0.5, least_numbers: float = 0.35) -> DataFrame:
        """(run_dir, run_no, change, field_path, new_path) of each run against the one
        before it in its folder; change is added, removed, retyped or renamed.

        A field counts as renamed from a likeness of ``least_likeness`` on, one of numbers
        from ``least_numbers`` on: the magnitudes of a few files vary more than their words.
        """
        runs = self.fields.select("run_dir", "run_no").distinct().unionByName(self.parsable.select("run_dir", "run_no")).distinct()
        order = runs.withColumn("before", F.lag("run_no").over(W.partitionBy("run_dir").orderBy("run_no"))).where("before is not null")
        held = self.fields.where("held")
        now = _joined(order, held, ["run_dir", "run_no"]).select("run_dir", "run_no", "before", "path", F.col("kind").alias("kind_now"), F.col("place").alias("place_now"))
        past = _joined(order, held.withColumnRenamed("run_no", "before"), ["run_dir", "before"]).select("run_dir", "run_no", "before", "path", F.col("kind").alias("kind_past"), F.col("place").alias("place_past"))
        both = _joined(now, past, ["run_dir", "run_no", "before", "path"], "full")
        differing = both.withColumn(
            "change", F.when(F.col("place_past").isNull(), "added").when(F.col("place_now").isNull(), "removed").when(F.col("kind_now") != F.col("kind_past"), "retyped")
        ).where("change is not null")
        differing = written(differing.withColumn("parent", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)), "field-changes")
        return self._with_renames(differing, least_likeness, least_numbers)

    def _with_renames(self, differing: DataFrame, least_likeness: float, least_numbers: float) -> DataFrame:
        ends = differing.where("change in ('added', 'removed')")
        # only parents under which one path ends and another begins can hold a renamed one
        group = ["run_dir", "run_no", "parent"]
        mixed = ends.groupBy(*group).agg(F.countDistinct("change").alias("c")).where("c = 2").select(*group)
        asked = _joined(ends, mixed, group).withColumn("at_run", F.when(F.col("change") == "added", F.col("run_no")).otherwise(F.col("before")))
        asked = written(asked.select(*group, "change", "path", "at_run", F.coalesce("place_now", "place_past").alias("place")), "asked-fields")
        runs = asked.groupBy("run_dir", F.col("at_run").alias("run_no")).agg(F.collect_set("path").alias("paths"))
        # rows say nothing of their size: one run may ask for any number of paths
        size = runs.agg(F.expr("sum(64 + octet_length(run_dir) + aggregate(paths, 0L, (n, p) -> n + 16 + octet_length(p)))")).first()[0] or 0
        wanted = self.files.join(F.broadcast(runs), ["run_dir", "run_no"]) if size <= BROADCAST_BYTES else _joined(self.files, runs, ["run_dir", "run_no"])
        cells = written(value_cells(wanted).withColumnRenamed("run_no", "at_run"), "value-cells")
        renamed = written(matched(likenesses(_joined(asked, cells, ["run_dir", "at_run", "path"]), group), group, least_likeness, least_numbers), "renamed-fields")
        taken = renamed.select("run_dir", "run_no", F.explode(F.array(F.struct(F.lit("removed").alias("change"), F.col("old").alias("path")), F.struct(F.lit("added").alias("change"), F.col("new").alias("path")))).alias("t")).select("run_dir", "run_no", "t.*")
        plain = _joined(differing, taken, ["run_dir", "run_no", "change", "path"], "left_anti")
        return plain.select("run_dir", "run_no", "change", F.col("path").alias("field_path"), F.lit("").alias("new_path")).unionByName(
            renamed.select("run_dir", "run_no", F.lit("renamed").alias("change"), F.col("old").alias("field_path"), F.col("new").alias("new_path"))
        )

    def schema(self, changes: DataFrame, most_paths: int = 10_000) -> list[tuple[str, str, list[str]]]:
        """(column, type, paths) of the union of all files' fields.

        Renamed paths share a column, named after the path that most files hold. Types
        are joined upwards: one of boolean and number stays, any two give string. Of more
        than ``most_paths`` distinct paths those that most files hold become columns; the
        others, a column named OTHERS of type map in which every leaf is kept.
        """
        paths = self.fields.groupBy("path").agg(F.sum("files").alias("files"), F.collect_set("kind").alias("kinds"))
        rows = {r.path: r for r in paths.orderBy(F.desc("files"), "path").limit(most_paths + 1).collect()}
        beyond = len(rows) > most_paths
        if beyond:
            rows.popitem()
        root = {p: p for p in rows}

        def find(p: str) -> str:
            while root[p] != p:
                p = root[p]
            return p

        # of the renames only those between columns are brought here
        spark = self.fields.sparkSession
        columns = F.broadcast(spark.createDataFrame([(p,) for p in rows], "p string"))
        renames = changes.where("change = 'renamed'").select("field_path", "new_path").distinct()
        renames = renames.join(columns.withColumnRenamed("p", "field_path"), "field_path").join(columns.withColumnRenamed("p", "new_path"), "new_path")
        for r in renames.orderBy("field_path", "new_path").collect():
            a, b = find(r.field_path), find(r.new_path)
            if a != b:
                low, high = sorted((a, b), key=lambda p: (rows[p].files, p))
                root[low] = high
        groups: dict[str, list[str]] = {}
        for p in sorted(rows):
            groups.setdefault(find(p), []).append(p)
        out, used = [], set()
        for head in sorted(groups):
            kinds = {k for p in groups[head] for k in rows[p].kinds}
            kind = {"boolean": "boolean", "number": "double"}[next(iter(kinds))] if len(kinds) == 1 and "string" not in kinds else "string"
            name = re.sub(r"\W+", "_", head.replace("[]", "")).strip("_") or "value"
            while name in used or name in ("file_id", "run_dir", "run_no"):
                name += "_"
            used.add(name)
            members = sorted(groups[head], key=lambda p: (-rows[p].files, p))
            out.append((name, f"array<{kind}>" if any("[]" in p for p in members) else kind, members))
        if beyond:
            while OTHERS[0] in used:
                out = [(name + "_" if name == OTHERS[0] else name, kind, members) for name, kind, members in out]
                used.discard(OTHERS[0])
            out.append((*OTHERS, []))
        return out

    def table(self, schema: list[tuple[str, str, list[str]]]) -> DataFrame:
        """One row per parsable file with the columns of ``schema``; a path inside an array gives
        an array with a place for each leaf in the file's order."""
        column_of = {p: (name, kind) for name, kind, paths in schema for p in paths}
        rest = (*OTHERS, []) in schema

        def cast(kind: str, value):
            if value is None:
                return None
            if kind.endswith("double") or kind == "array<double>":
                return float(value)
            if "boolean" in kind:
                return bool(value)
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for i, d, n, b in zip(f["file_id"], f["run_dir"], f["run_no"], f["body"]):
                    try:
                        doc = json.loads(b)
                    except (TypeError, ValueError, RecursionError):
                        continue
                    row: dict = {"file_id": i, "run_dir": d, "run_no": n}
                    for path, _, value, _ in leaves(doc):
                        name, kind = column_of.get(path, (None, ""))
                        if name is None:
                            if rest:
                                row.setdefault(OTHERS[0], {}).setdefault(path, []).append(cast("string", value))
                            continue
                        if kind.startswith("array"):
                            row.setdefault(name, []).append(cast(kind, value))
                        elif row.get(name) is None:
                            row[name] = cast(kind, value)
                    rows.append(row)
                names = ["file_id", "run_dir", "run_no", *[name for name, _, _ in schema]]
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

        kept = self.files.dropDuplicates(["file_id", "run_dir", "run_no"])
        columns = ", ".join(["file_id bigint, run_dir string, run_no int", *[f"`{name}` {kind}" for name, kind, _ in schema]])
        return kept.mapInPandas(run, columns)


def likenesses(cells: DataFrame, group: list[str]) -> DataFrame:
    """How alike, from 0 to 1, the values of each ended and each begun field of a group are
    that have a histogram cell in common: old, new, likeness, numeric, apart (places).

    ``cells`` has the group, change, path, place, bin, n. Cells meet in a join, so neither the
    values of a field nor the fields of a group are collected; a cell is one row, however often
    its value occurs.
    """
    side = [*group, "change", "path", "place"]
    kinds = cells.withColumn("kind", F.substring("bin", 1, 1))
    own = W.partitionBy(*side)
    many = lambda *k: F.sum(F.when(F.col("kind").isin(*k), F.col("n")).otherwise(0)).over(own)
    totals = {f"n_{k}": many(k) for k in "mvbsoi"} | {"n_w": many("i", "f")}
    of_kind = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"n_{k}")) for k in "mvbso"])
    # magnitudes are smoothed to their neighbours; what says too little about a field is left out
    size = F.regexp_extract("bin", r"^m[+-](-?\d+)$", 1)
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.struct(F.concat(F.substring("bin", 1, 2), (size.cast("int") + d).cast("string")).alias("bin"), F.when(d == 0, 0.5).otherwise(0.25).alias("part")))
    alone = F.array(F.struct(F.col("bin").alias("bin"), F.lit(1.0).alias("part")))
    plain = ["slati", "olatin", "omixed", "o9", "o"]
    shares = (
        kinds.withColumns(totals)
        .where(~F.col("kind").isin("i", "f") & ~F.col("bin").isin(plain))
        .withColumn("c", F.explode(F.when(size != "", near).otherwise(alone)))
        .groupBy(*side, *totals, "kind", F.col("c.bin").alias("bin"))
        .agg(F.sum(F.col("n") * F.col("c.part") / of_kind).alias("share"))
        .withColumn("n_all", F.greatest(F.lit(1), F.col("n_m") + F.col("n_v") + F.col("n_b")))
    )
    counts = [*totals, "n_all"]
    ended = lambda change, name, s: shares.where(F.col("change") == change).drop("change").withColumnsRenamed({"path": name, "place": f"place_{s}", "share": f"share_{s}"} | {c: f"{c}_{s}" for c in counts})
    both = _joined(ended("removed", "old", "a"), ended("added", "new", "b"), [*group, "kind", "bin"])
    least = lambda *ks: F.sum(F.when(F.col("kind").isin(*ks), F.least("share_a", "share_b")).otherwise(0.0))
    given = lambda s: F.sum(F.when(F.col("kind") == "v", F.col(f"share_{s}")).otherwise(0.0))
    once = [F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in [*counts, "place"] for s in "ab"]
    met = both.groupBy(*group, "old", "new").agg(least("m").alias("m"), least("s").alias("s"), least("o").alias("o"), F.least(given("a"), given("b")).alias("v"), F.count_if(F.col("kind") == "v").alias("shared"), *once)
    part = lambda k: F.least(*[F.col(f"n_{k}_{s}") / F.col(f"n_all_{s}") for s in "ab"])
    whole = lambda s: F.coalesce(F.try_divide(F.col(f"n_i_{s}").cast("double"), F.col(f"n_w_{s}")), F.lit(0.0))
    # of values from a small set a few files show some only: one in both is enough, more rank higher
    values = F.when(F.col("shared") > 0, 0.5 + 0.5 * F.col("v")).otherwise(0.0)
    score = part("m") * F.col("m") * (1 - F.abs(whole("a") - whole("b"))) + part("v") * F.greatest(values, "s", "o") + part("b")
    return met.select(*group, "old", "new", F.round(score, 2).alias("likeness"), ((F.col("n_m_a") > 0) & (F.col("n_m_b") > 0)).alias("numeric"), F.abs(F.col("place_a") - F.col("place_b")).alias("apart"))


def matched(pairs: DataFrame, group: list[str], least_likeness: float, least_numbers: float) -> DataFrame:
    """(run_dir, run_no, old, new): in each group the likest pair first, each field once. A
    group's fields are those of one JSON object, so its pairs that are alike enough are few."""
    enough = pairs.where(F.col("likeness") >= F.when(F.col("numeric"), least_numbers).otherwise(least_likeness))
    ranked = enough.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct((-F.col("likeness")).alias("rank"), "apart", "old", "new"))).alias("pairs"))
    kept = F.array().cast("array<struct<old:string,new:string>>")

    def take(acc, p):
        free = ~F.exists(acc, lambda t: (t["old"] == p["old"]) | (t["new"] == p["new"]))
        return F.when(free, F.concat(acc, F.array(F.struct(p["old"].alias("old"), p["new"].alias("new"))))).otherwise(acc)

    return ranked.select("run_dir", "run_no", F.explode(F.aggregate("pairs", kept, take)).alias("p")).select("run_dir", "run_no", "p.*")
