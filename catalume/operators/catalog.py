"""Catalog reads: paths, predicates, tag joins, sizes, statistics, orders."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, human_size

# Names of system files and directories. A catalog file kept inside the tree is added by its owner.
SYSTEM_NAMES = ("@eaDir", "@eaStream", "@tmp", "@SynoResource", "@SynoEAStream", "#recycle", ".SynologyWorkingDirectory")


@dataclass(frozen=True)
class Visibility:
    """What a listing shows. System files are exempt from the dotfile and glob rules."""

    system: tuple[str, ...] = SYSTEM_NAMES
    globs: tuple[str, ...] = field(default_factory=tuple)
    show_system: bool = False
    show_hidden: bool = False


def full_path(root: Column, directory: Column, name: Column) -> Column:
    """F1."""
    return F.concat(root, F.when(directory != "", F.concat(F.lit("/"), directory)).otherwise(F.lit("")), F.lit("/"), name)


def catalog(scans: DataFrame, dirs: DataFrame, files: DataFrame, scan_id: int | None = None) -> DataFrame:
    """One row per file with its scan and directory; scans are few and come from the catalog's own header table."""
    joined = files.join(dirs.withColumnRenamed("path", "dir"), "dir_id").join(scans.select("scan_id", "root_path"), "scan_id")
    joined = joined.withColumn("full_path", full_path(F.col("root_path"), F.col("dir"), F.col("filename")))
    return joined if scan_id is None else joined.where(F.col("scan_id") == scan_id)


def find(files: DataFrame, pattern: str, scan_id: int | None = None, insensitive: bool = False) -> DataFrame:
    """regex search on the full path; folding is Unicode's simple folding, so no ss for sharp s."""
    hit = files.where(F.col("full_path").rlike(f"(?iu){pattern}" if insensitive else pattern))
    return hit if scan_id is None else hit.where(F.col("scan_id") == scan_id)


def is_system(directory: Column, name: Column, names: tuple[str, ...] = SYSTEM_NAMES) -> Column:
    """Any component of the directory, or the name, equals a system name."""
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return F.arrays_overlap(F.split(directory, "/"), listed) | F.array_contains(listed, name)


def exclude_system(files: DataFrame, names: tuple[str, ...] = SYSTEM_NAMES) -> DataFrame:
    """F4."""
    return files.where(~is_system(F.col("dir"), F.col("filename"), names))


def exclude_components(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """directory components only."""
    return files.where(~F.arrays_overlap(F.split("dir", "/"), F.array(*[F.lit(n) for n in names])))


def glob_regex(glob: str) -> str:
    """An anchored Java regex for a shell glob of one path part; raises on an unclosed class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "^", "]") else i + 1)
            if end < 0:
                raise ValueError(f"unclosed class in {glob!r}")
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body[:1] in ("!", "^") else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_globs(name: Column, globs: tuple[str, ...]) -> Column:
    """bad globs are dropped with a warning."""
    hit = F.lit(False)
    for glob in globs:
        try:
            hit = hit | name.rlike(glob_regex(glob))
        except ValueError as e:
            warnings.warn(str(e), stacklevel=2)
    return hit


def visible(config: Visibility = Visibility(), directory: str = "dir", name: str = "filename") -> Column:
    """F4, F6, F7, F8 in one predicate."""
    system = is_system(F.col(directory), F.col(name), config.system)
    shown = F.lit(True) if config.show_system else ~system
    if not config.show_hidden:
        shown = shown & (system | ~F.col(name).startswith("."))
    return shown & (system | ~matches_globs(F.col(name), config.globs))


def hide_dotfiles(files: DataFrame, system: tuple[str, ...] = SYSTEM_NAMES) -> DataFrame:
    """names that start with a dot go, system names stay."""
    return files.where(~F.col("filename").startswith(".") | F.col("filename").isin(*system))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def list_under(files: DataFrame, prefix: str, strict: bool = False) -> DataFrame:
    """prefix listing, LIKE with ASCII folding and live wildcards, or plain with ``strict``."""
    if strict:
        return files.where(F.col("full_path").startswith(prefix))
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in prefix)
    return files.where(ascii_fold(F.col("full_path")).like(folded.replace("\\", "\\\\") + "%"))


def find_by_suffix(files: DataFrame, suffix: str) -> DataFrame:
    """the first path, by order, that ends so."""
    return files.where(F.col("full_path").endswith(suffix)).orderBy("full_path").limit(1)


def file_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """J2."""
    return files.join(tags, "file_id")


def find_by_tag(files: DataFrame, tags: DataFrame, tag: str, value: str) -> DataFrame:
    """exact tag name, LIKE on its value; a value without wildcard is searched for anywhere."""
    pattern = value if "%" in value or "_" in value else f"%{value}%"
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in pattern)
    return file_tags(files, tags.where((F.col("tag_name") == tag) & ascii_fold(F.col("value")).like(folded.replace("\\", "\\\\")))).orderBy("dir", "filename")


def where(files: DataFrame, tags: DataFrame, predicate: str) -> DataFrame:
    """Distinct paths whose file, with or without tags, meets a SQL predicate, by directory and name."""
    return files.join(tags, "file_id", "left").where(F.expr(predicate)).select("full_path", "dir", "filename").distinct().orderBy("dir", "filename")


def needs_metadata(files: DataFrame, extensions: tuple[str, ...], force: bool = False) -> DataFrame:
    """listed extension, and never scanned or scanned before the file changed."""
    stale = F.lit(True) if force else F.col("metadata_scanned_at").isNull() | (F.col("metadata_scanned_at") < F.timestamp_seconds("mtime"))
    return files.where(extension(F.col("filename")).isin(*extensions) & stale)


def totals(files: DataFrame) -> DataFrame:
    """A1."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def subtree_size(files: DataFrame, prefix: str) -> DataFrame:
    """A2: the directory itself or anything below; the empty prefix is everything."""
    inside = files if prefix == "" else files.where((F.col("dir") == prefix) | F.col("dir").startswith(prefix + "/"))
    return inside.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def dir_sizes(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes below each top-level directory, empty ones too; files of the root don't count."""
    sizes = files.groupBy("dir_id").agg(F.sum("size").alias("size"))
    top = dirs.where("path <> ''").join(sizes, "dir_id", "left").groupBy("scan_id", F.substring_index("path", "/", 1).alias("top_dir"))
    return top.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")).orderBy("scan_id", "top_dir")


def ancestors(directory: Column) -> Column:
    """All directories above a path and itself, the root as an empty name."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def usage(files: DataFrame) -> DataFrame:
    """A4: bytes and files at or below every directory."""
    each = files.groupBy("scan_id", "dir").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return each.withColumn("at", F.explode(ancestors(F.col("dir")))).groupBy("scan_id", "at").agg(F.sum("size").alias("total_size"), F.sum("n").alias("n_files"))


def ext_counts(files: DataFrame) -> DataFrame:
    """A5, O3."""
    named = files.select(extension(F.col("filename")).alias("ext")).where("ext <> ''")
    return named.groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


def stats(files: DataFrame, config: Visibility = Visibility()) -> DataFrame:
    """One row with totals, readable size and the extension counts as a map."""
    shown = files.where(visible(config))
    exts = ext_counts(shown).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))
    return totals(shown).withColumn("size_text", human_size(F.col("total_size"))).crossJoin(exts)


def tree_counts(dirs: DataFrame, files: DataFrame, config: Visibility = Visibility()) -> DataFrame:
    """Directories (with the root) and files of each scan after filters."""
    shown = files.where(visible(config)).groupBy("scan_id").agg(F.count("*").alias("n_files"))
    listed = F.array(*[F.lit(n) for n in config.system])
    below = dirs if config.show_system else dirs.where(~F.arrays_overlap(F.split("path", "/"), listed))
    counted = below.select("scan_id", F.explode(ancestors(F.col("path"))).alias("at")).distinct().groupBy("scan_id").agg(F.count("*").alias("n_dirs"))
    return counted.join(shown, "scan_id", "left").select("scan_id", "n_dirs", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def blob_refs(references: DataFrame) -> DataFrame:
    """References and size per content hash."""
    return references.groupBy("hash").agg(F.count("*").alias("ref_count"), F.max("size").alias("size"))


def orphan_blobs(store: DataFrame, references: DataFrame) -> DataFrame:
    """J8."""
    return store.join(references.where("hash is not null").select("hash"), "hash", "left_anti")


def tag_values(items: DataFrame) -> DataFrame:
    """Values ``(file_id, tag_name, pos, value)`` to one text per tag: a scalar, or a JSON array in order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    return items.groupBy("file_id", "tag_name").agg(values.alias("v")).select("file_id", "tag_name", F.when(F.size("v") == 1, F.col("v")[0]).otherwise(F.to_json("v")).alias("value"))


def latest_scan(scans: DataFrame, run_type: str | None = None) -> DataFrame:
    """The scan finished last."""
    done = scans.where("finished_at is not null")
    if run_type is not None:
        done = done.where(F.col("run_type") == run_type)
    return done.orderBy(F.desc("finished_at"), F.desc("scan_id")).limit(1)


def collation_keys(c: Column) -> list[Column]:
    """O1: letters first by Unicode collation without punctuation, then with it."""
    bare = F.regexp_replace(c, r"[\p{P}\p{S}\s]", "")
    return [F.collate(bare, "UNICODE"), F.collate(c, "UNICODE")]


def same_name(a: Column, b: Column) -> Column:
    """Whether two names are equal but for case and accents; null where one is null."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def name_counts(df: DataFrame, column: str) -> DataFrame:
    """``(name, n)`` of names that are one but for case and accents, by the smallest spelling in code-point order."""
    folded = df.select(F.col(column).alias("name"), F.collate(F.col(column), "UNICODE_CI_AI").alias("folded"))
    return folded.groupBy("folded").agg(F.min("name").alias("name"), F.count("*").alias("n")).select("name", "n")


def collate_order(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[k for c in columns for k in collation_keys(F.col(c))])


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def tree_rows(files: DataFrame, dirs: DataFrame | None = None, config: Visibility = Visibility(), globs: tuple[str, ...] = ()) -> DataFrame:
    """One row per node of each scan's tree, all ancestors present, parents before children.

    A directory or file whose name meets a glob goes with all below it.
    """
    shown = files.where(visible(config))
    nodes = shown.select("scan_id", F.when(F.col("dir") == "", F.col("filename")).otherwise(F.concat_ws("/", "dir", "filename")).alias("path"), F.lit(False).alias("is_dir"))
    above = [shown.select("scan_id", "dir").distinct()]
    if dirs is not None:
        listed = F.array(*[F.lit(n) for n in config.system])
        above.append(dirs.select("scan_id", F.col("path").alias("dir")) if config.show_system else dirs.select("scan_id", F.col("path").alias("dir")).where(~F.arrays_overlap(F.split("dir", "/"), listed)))
    folders = above[0] if len(above) == 1 else above[0].union(above[1])
    folders = folders.select("scan_id", F.explode(ancestors(F.col("dir"))).alias("path")).where("path <> ''").distinct().withColumn("is_dir", F.lit(True))
    every = nodes.union(folders).withColumn("parts", F.split("path", "/"))
    if globs:
        every = every.where(~F.exists("parts", lambda p: matches_globs(p, globs)))
    keyed = every.withColumn("sort_key", F.transform("parts", lambda p: F.concat(F.lower(F.regexp_replace(p, r"[\p{P}\p{S}\s]", "")), F.lit("\u0001"), p)))
    return keyed.select("scan_id", "path", (F.size("parts") - 1).alias("depth"), F.element_at("parts", -1).alias("name"), "is_dir", "sort_key").orderBy("scan_id", "sort_key")
