"""Import resolution, dependents, call chains and the tests of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S


def folded(path: Column) -> Column:
    """. and .. taken out of a path."""
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))), "/")


def parent(path: Column, levels: Column | int = 1) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(0))), "/")


def suffix_index(files: DataFrame, path: Column, value: Column, order: Column) -> DataFrame:
    """(suffix, dst): for each suffix of the paths, from a segment on, the value of the best row; an exact path comes first, then
    the least order. One row a suffix, so a suffix that many files share multiplies nothing."""
    named, parts = files.select(path.alias("whole"), value.alias("value"), order.alias("order")), F.split("whole", "/")
    each = named.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    return each.groupBy("suffix").agg(F.min_by("value", F.struct((F.col("whole") != F.col("suffix")).cast("int"), "order")).alias("dst"))


def resolve(raw_imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (src, dst): each of raw_imports (path, pos, level, target) to the best of files (path), never to itself.

    Relative imports have ranked exact candidates. Absolute ones are matched as path suffixes through `suffix_index`.
    Best: exact path, no "test" in it, under a source root, short, then by path.
    """
    slashed = F.translate("target", ".", "/")
    base = F.concat_ws("/", F.nullif(parent(F.col("path"), F.col("level")), F.lit("")), F.nullif(slashed, F.lit("")))
    joined = folded(F.concat_ws("/", parent(F.col("path")), "target"))
    # a name with a script's extension may stand for its source
    other = F.regexp_replace(joined, "(" + "|".join(e.replace(".", r"\.") for e in C.SCRIPT_EXTENSIONS) + ")$", "")
    ends = lambda stem, each: F.array(*[F.concat(stem, F.lit(e)) for e in each])
    dotted = F.col("target").startswith("./") | F.col("target").startswith("../")
    exact = F.when(F.col("level") > 0, ends(base, (".py", "/__init__.py"))).when(dotted, F.array_distinct(F.concat(ends(joined, C.STEMS), ends(other, C.STEMS))))
    own = raw_imports.select("path", "pos", "level", "target").distinct()
    near = own.select("path", "pos", F.posexplode(exact).alias("rank", "candidate")).join(files.select(F.col("path").alias("candidate")), "candidate")
    near = near.groupBy("path", "pos").agg(F.min_by("candidate", "rank").alias("dst"))
    far = own.where((F.col("level") == 0) & ~dotted & (F.col("target") != "")).select("path", "pos", F.posexplode(ends(slashed, C.ABSOLUTE)).alias("rank", "suffix"))
    score = F.struct(F.lower("path").contains("test").cast("int"), (~F.element_at(F.split("path", "/"), 1).isin(*C.SOURCE_ROOTS)).cast("int"), F.length("path"), F.col("path"))
    hits = far.join(suffix_index(files, F.col("path"), F.col("path"), score), "suffix").groupBy("path", "pos").agg(F.min_by("dst", "rank").alias("dst"))
    return near.unionByName(hits).where("path <> dst").select(F.col("path").alias("src"), "dst").distinct()


def dependents(deps: DataFrame) -> DataFrame:
    """path, dependents (number of distinct sources)."""
    return deps.select("src", "dst").distinct().groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"))


def inverse(deps: DataFrame) -> DataFrame:
    """path, dependent_paths (sorted): the answer is a list for each path, as long as its dependents are many."""
    return deps.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("dependent_paths"))


def within(refs: DataFrame, scope: DataFrame) -> DataFrame:
    """The references in files of the scope (path)."""
    return refs.join(scope.select("path"), "path", "left_semi")


def without(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """The references that are no definition (path, line)."""
    return refs.join(definitions.select("path", "line"), ["path", "line"], "left_anti")


def call_chain(routes: DataFrame, symbols: DataFrame, calls: DataFrame, classes: DataFrame, effects: DataFrame) -> DataFrame:
    """route -> handler -> called methods -> their file's side effects, one row a call (a handler without calls: one row).

    routes: route, handler; symbols: handler_path, handler; calls: handler_path, handler, class_name, method_name, inferred;
    classes: class_name, class_path, methods; effects: class_path, side_effects.
    """
    steps = routes.select("route", "handler").join(symbols, "handler").join(calls, ["handler_path", "handler"], "left")
    steps = steps.join(classes, "class_name", "left").where("methods is null or array_contains(methods, method_name)")
    return steps.join(effects, "class_path", "left").select("route", "handler", "handler_path", "class_name", "method_name", "inferred", "class_path", "side_effects")


def _flat(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "_", "")


def _pieces(text: Column, least: int) -> Column:
    """All distinct substrings of at least so many characters; of names, which are short."""
    n = F.length(text)
    from_each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(n - i + 1 >= least, F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.substring(text, i, k))).otherwise(F.array().cast("array<string>")))
    return F.when(n >= least, F.array_distinct(F.flatten(from_each))).otherwise(F.array().cast("array<string>"))


def tests_for(files: DataFrame, deps: DataFrame, target: Column | None = None) -> DataFrame:
    """Distinct (path, test): tests that import a file, are named like it, hold its module's path, or its name of four letters or more.

    files: path, is_test. Every rule is an equi-join. A test's name is cut into its substrings for the last rule. A module's path of
    several segments stands in a test's path only if its last segment begins one there right after the end of the one before, so
    tests are keyed by the beginnings of their segments; a module of one segment is a substring of one. The exact test follows.
    Pass `target`, a condition on path, to ask about some files.
    """
    sources = files.where(target if target is not None else F.lit(True)).select("path")
    base = _flat(F.regexp_replace(S.stem(F.col("path")), "test_", ""))
    bare = F.split(F.regexp_replace("path", r"(?<=[^/])\.[^./]+$", ""), "/")
    s = sources.select("path", base.alias("base"), _flat(F.array_join(F.filter(bare, lambda x: ~x.isin("src", "lib")), "/")).alias("module"))
    stem = _flat(S.stem(F.col("path")))
    whole = _flat(F.array_join(F.filter(bare, lambda x: ~x.isin("tests", "test", "spec")), "/"))
    tests = files.where("is_test").select(F.col("path").alias("test"), stem.alias("stem"), F.regexp_replace(stem, "^test", "").alias("own"), whole.alias("whole"))
    imported = deps.join(tests.select(F.col("test").alias("src")), "src").select(F.col("dst").alias("path"), F.col("src").alias("test")).join(sources, "path", "left_semi")
    named = s.where("base <> ''").join(tests, F.col("base") == F.col("own")).select("path", "test")
    stems = tests.select("test", F.explode(_pieces(F.col("stem"), 4)).alias("base"))
    by_stem = s.where("length(base) >= 4").join(stems, "base").select("path", "test")
    parts, last = F.split("whole", "/"), F.split("module", "/")
    # a segment's beginnings, after the last letter of the segment before it
    begun = F.flatten(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(0), F.length(F.element_at(parts, i))), lambda k: F.concat(F.right(F.element_at(parts, i - 1), F.lit(1)), F.lit("/"), F.substring(F.element_at(parts, i), F.lit(1), k)))))
    keys = F.array_union(F.when(F.size(parts) > 1, begun).otherwise(F.array().cast("array<string>")), F.flatten(F.transform(parts, lambda p: _pieces(p, 1))))
    key = F.when(F.size(last) > 1, F.concat(F.right(F.element_at(last, -2), F.lit(1)), F.lit("/"), F.element_at(last, -1))).otherwise(F.col("module"))
    held = s.where("module <> ''").withColumn("key", key).join(tests.select("test", "whole", F.explode(keys).alias("key")), "key").where(F.col("whole").contains(F.col("module"))).select("path", "test")
    return imported.unionByName(named).unionByName(by_stem).unionByName(held).distinct()
