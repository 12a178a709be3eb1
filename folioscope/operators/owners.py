"""Owners of paths: rule files parsed to rows, last matching rule wins, counts per owner key, fix plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs

#: The key of files without owners.
NOBODY = "_no_owner_"
#: The most rules that are folded into one expression.
MOST_RULES = 10_000


def parse_rules(text: str) -> tuple[list[dict], list[str]]:
    """Rules and default owners of an owners file.

    Comments go from ``#`` on; a line needs a pattern and a word more; only words with ``@`` are owners; a rule without any
    is dropped. ``*`` sets the default, the last one wins.
    """
    rules, default = [], []
    for number, line in enumerate(text.split("\n"), 1):
        words = line.split("#", 1)[0].split()
        owners = [w for w in words[1:] if "@" in w]
        if len(words) < 2 or not owners:
            continue
        if words[0] == "*":
            default = owners
            continue
        regex, under = globs.rule_regexes(words[0])
        rules.append({"line_number": number, "pattern": words[0], "owners": owners, "is_negation": words[0].startswith("!"), "regex": regex, "dir_regex": under})
    return rules, default


def owners_of(path: Column, rules: Sequence[dict], default: Sequence[str] = ()) -> Column:
    """The owners of a path, as one CASE over the rules from last to first, so that no join is needed.

    A negation that matches last clears the owners. Leading dots and slashes of the path are stripped.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    bare = F.regexp_replace(path, r"^[./]+", "")
    case = None
    for r in sorted(rules, key=lambda r: -r["line_number"]):
        hit = bare.rlike(r["regex"])
        if r["dir_regex"]:
            hit = hit | bare.rlike(r["dir_regex"])
        value = strings([] if r["is_negation"] else r["owners"])
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return strings(default) if case is None else case.otherwise(strings(default))


def owner_key(owners: Column) -> Column:
    """Owners sorted and joined by commas; ``_no_owner_`` for none."""
    return F.when(F.size(owners) > 0, F.array_join(F.array_sort(owners), ",")).otherwise(NOBODY)


def keyed(files: DataFrame, rules: Sequence[dict], default: Sequence[str] = (), path: str = "doc_path") -> DataFrame:
    """``files`` with owners and owner_key."""
    named = files.withColumn("owners", owners_of(F.col(path), rules, default))
    return named.withColumn("owner_key", owner_key(F.col("owners")))


def distinct_owners(rules: DataFrame, default: Sequence[str] = ()) -> DataFrame:
    """(owner): every owner of the rules and of the default, once."""
    own = rules.select(F.explode("owners").alias("owner"))
    if default:
        own = own.unionByName(rules.sparkSession.createDataFrame([(x,) for x in default], "owner string"))
    return own.distinct()


def group_counts(results: DataFrame) -> DataFrame:
    """Per owner_key: broken links, the files they are in, and all files; owners without a broken link are there as well."""
    broken = F.col("status") == "broken"
    return results.groupBy("owner_key").agg(
        F.count_if(broken).alias("broken"), F.count_distinct(F.when(broken, F.col("doc_path"))).alias("files_affected"), F.count_distinct("doc_path").alias("files")
    )


def files_of(files: DataFrame, path: str = "doc_path") -> DataFrame:
    """(owner_key, path): each file under its owners' key, once; files without owners under ``_no_owner_``.

    Rows and not a list for each key, since one owner may have most of the files.
    """
    return files.select("owner_key", F.col(path).alias("path")).distinct()


def fixable(broken: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per owner_key of ``broken`` (link_id, doc_path, owner_key): broken links, those with an automatic fix, the files of either."""
    auto = fixes.where("auto_fixable").select("link_id", F.lit(True).alias("auto")).distinct()
    rows = broken.join(auto, "link_id", "left")
    return rows.groupBy("owner_key").agg(
        F.count("*").alias("broken"), F.count_if("auto").alias("fixable"), F.count_distinct("doc_path").alias("files"), F.count_distinct(F.when(F.col("auto"), F.col("doc_path"))).alias("files_to_fix")
    )


def first_fixes(fixes: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` automatic fixes of each owner_key, in order of file, line and url (the limit is the feature)."""
    order = Window.partitionBy("owner_key").orderBy("file_path", "line", "original_url", "link_id")
    ranked = fixes.where("auto_fixable").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return ranked.select("owner_key", "n", "file_path", "line", "original_url", "suggested_url")


def chosen(groups: DataFrame, only: Sequence[str] = (), skip: Sequence[str] = ()) -> DataFrame:
    """Groups whose key contains one of ``only`` (if any is given) and none of ``skip``."""
    key = F.col("owner_key")
    out = groups
    if only:
        out = out.where(F.exists(F.array(*map(F.lit, only)), lambda o: key.contains(o)))
    if skip:
        out = out.where(~F.exists(F.array(*map(F.lit, skip)), lambda o: key.contains(o)))
    return out


def branch_name(owners: Column, prefix: str = "docs/fix-") -> Column:
    """A branch name of the first owner: ``@`` dropped, ``/`` and ``_`` to hyphens, other marks deleted."""
    first = F.regexp_replace(F.regexp_replace(F.ltrim(F.try_element_at(owners, F.lit(1)), F.lit("@")), "[/_]", "-"), "[^a-zA-Z0-9-]", "")
    return F.concat(F.lit(prefix), F.when(F.size(owners) > 0, first).otherwise("no-owner"))


def fix_plan(fixes: DataFrame, prefix: str = "docs/fix-") -> DataFrame:
    """Per owner_key with something to fix: branch, title and the table of changes, in order of file and line.

    ``fixes`` has owner_key, owners, file_path, line, original_url, suggested_url, description and auto_fixable. The title
    is null for files without owners.
    """
    row = F.concat(F.lit("| "), F.col("line").cast("string"), F.lit(" | `"), "original_url", F.lit("` → `"), "suggested_url", F.lit("` | "), "description", F.lit(" |"))
    auto = fixes.where("auto_fixable").withColumn("row", row)
    per_file = auto.groupBy("owner_key", "file_path").agg(F.first("owners").alias("owners"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    section = F.concat(F.lit("### `"), "file_path", F.lit("`\n\n| Line | Change | Description |\n|------|--------|-------------|\n"), "rows", F.lit("\n"))
    plan = per_file.withColumn("section", section).groupBy("owner_key").agg(
        F.first("owners").alias("owners"), F.sum("n").alias("n_fixes"), F.count("*").alias("n_files"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", "section"))), lambda x: x["section"]), "\n").alias("changes"),
    )
    title = F.when(F.size("owners") > 0, F.concat(F.lit("fix(docs): Fix "), F.col("n_fixes").cast("string"), F.lit(" broken links in "), F.col("owners")[0], F.lit(" owned files")))
    return plan.select("owner_key", branch_name(F.col("owners"), prefix).alias("branch"), title.alias("title"), "n_fixes", "n_files", F.concat(F.lit("## Changes\n\n"), "changes").alias("body"))
