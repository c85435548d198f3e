"""A corpus and the questions about it. Every answer is a lazy DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions import scalars as S
from ..operators import extract, graph, history, text
from ..sources.tree import Settings, read_tree, stale

NEEDED = {"files": ("path", "lang", "lines", "is_test", "analyzer", "precision", "confidence", "text", "code"), "symbols": ("path", "pos", "name", "kind", "line", "end_line", "methods", "signature"), "raw_imports": ("path", "pos", "level", "target"), "refs": ("path", "line", "ident", "alias_of", "attribute", "shadowed"), "calls": ("path", "symbol", "class_name", "method_name", "inferred")}
TABLES = ("files", "symbols", "imports", "raw_imports", "refs", "calls", "routes", "side_effects", "findings", "deps")


class Corpus:
    """The tables of one snapshot, as DataFrames by name."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables, self.known = tables, {}

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def of(cls, files: DataFrame, settings: Settings = Settings()) -> Corpus:
        """From path, text (size, mtime): one parse a file."""
        known = extract.analyzed(files).persist()
        path = F.col("path")
        table = {}
        table["files"] = known.select("path", S.language(path).alias("lang"), F.size(S.lines(F.col("text"))).alias("lines"), S.is_test(path, settings.test_dirs, settings.test_patterns).alias("is_test"), "analyzer", S.precision(F.col("analyzer")).alias("precision"), S.confidence(F.col("analyzer")).alias("confidence"), "text", "code", *[c for c in ("size", "mtime") if c in files.columns])
        for name in ("symbols", "raw_imports", "refs", "calls"):
            table[name] = known.select("path", "analyzer", F.explode(name).alias("x")).select("path", "analyzer", S.precision(F.col("analyzer")).alias("precision"), S.confidence(F.col("analyzer")).alias("confidence"), "x.*")
        table["imports"] = known.select("path", F.posexplode("imports").alias("pos", "name"))
        routes = known.select("path", F.posexplode(S.routes(F.col("text"))).alias("pos", "r")).select("path", "pos", F.col("r.k").alias("route"), F.col("r.v").alias("handler"))
        table["routes"] = routes.groupBy("path", "route").agg(F.max_by("handler", "pos").alias("handler"))
        table["side_effects"] = known.select("path", F.explode(S.side_effects(F.col("code"), settings.side_effects)).alias("label"))
        table["findings"] = known.select("path", F.explode(S.findings(F.col("code"))).alias("label"))
        table["deps"] = graph.resolve(table["raw_imports"], table["files"]).persist()  # most questions need the edges
        return cls(table)

    @classmethod
    def scan(cls, spark: SparkSession, root: str, settings: Settings = Settings()) -> Corpus:
        return cls.of(read_tree(spark, root, settings), settings)

    def save(self, path: str) -> None:
        for name in TABLES:
            self.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        """A stored corpus; one that lacks a column that questions need was stored by another version and is refused."""
        found = cls({name: spark.read.parquet(f"{path}/{name}") for name in TABLES})
        lacking = [f"{name}.{c}" for name, columns in NEEDED.items() for c in columns if c not in found.tables[name].columns]
        if lacking:
            raise ValueError(f"{path} lacks {', '.join(lacking)}: scan the tree anew")
        return found

    def freshness(self, spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
        """How many files are new, changed or deleted since the corpus was stored; no row: none."""
        return stale(self.files.select("path", "size", "mtime"), read_tree(spark, root, settings).select("path", "size", "mtime")).groupBy("state").agg(F.count("*").alias("files"))

    # ------------------------------------------------------------ shared parts

    def dependents(self) -> DataFrame:
        return graph.dependents(self.deps)

    def tests(self, condition=None) -> DataFrame:
        """(path, test) of the files that meet a condition on path; of all files it is worked out once."""
        if condition is not None:
            return graph.tests_for(self.files, self.deps, condition)
        if "tests" not in self.known:
            self.known["tests"] = graph.tests_for(self.files, self.deps).persist()
        return self.known["tests"]

    def facts(self) -> DataFrame:
        """path, role, dependents, symbols, lines, raw_tokens of every file."""
        symbols = self.symbols.groupBy("path").agg(F.count("*").alias("symbols"))
        rows = self.files.join(self.dependents(), "path", "left").join(symbols, "path", "left").fillna(0, ["dependents", "symbols"])
        return rows.select("path", "lang", S.role(F.col("path"), F.col("is_test")).alias("role"), S.precision_label(F.col("analyzer")).alias("trust"), "is_test", "dependents", "symbols", "lines", S.tokens(F.col("text")).alias("raw_tokens"))

    def find(self, name: str) -> DataFrame:
        """Symbols by name, best first: equal, then methods that end in .name, then classes that have such a method."""
        n = S.without_receiver(F.col("name"))
        want = F.lit(name)
        listed = F.array_contains(F.transform("methods", lambda m: F.concat(n, F.lit("."), m)), want)
        tier = F.when((F.col("name") == want) | (n == want), 1).when(n.endswith("." + name), 2).when(listed, 3)
        return self.symbols.withColumn("tier", tier).where("tier is not null").orderBy("tier", "path", "pos")

    def references(self, name: str) -> DataFrame:
        """path, line, text of uses of a name: reads that nothing around rebinds, its import aliases, attributes."""
        bare = name.rsplit(".", 1)[-1]
        hits = self.refs.where(((F.col("ident") == bare) & (F.col("attribute") | ~F.col("shadowed"))) | ((F.col("alias_of") == bare) & ~F.col("shadowed"))).select("path", "line").distinct()
        lines = text.line_table(self.files.join(hits.select("path").distinct(), "path", "left_semi"))
        return hits.withColumn("line", F.col("line").cast("long")).join(lines, ["path", "line"]).select("path", "line", S.strip(F.col("text")).alias("text")).orderBy("path", "line", "text")

    # ------------------------------------------------------------ questions

    def map(self, top: int = 20) -> DataFrame:
        return text.important(self.facts(), top)

    def languages(self) -> DataFrame:
        """Files of each language but tests, and which language is the primary one."""
        return text.histogram(self.files.where("not is_test"))

    def counts(self) -> DataFrame:
        """One row: code_files (tests are code, too), test_files."""
        return self.files.agg(F.count_if(S.suffix(F.col("path")).isin(*C.CODE_EXTENSIONS)).alias("code_files"), F.count_if("is_test").alias("test_files"))

    def read(self, path: str) -> DataFrame:
        own = lambda df, c: df.where(F.col("path") == path).agg(F.array_sort(F.collect_set(c)).alias(c))
        symbols = self.symbols.where((F.col("path") == path) & (F.col("kind") != "method")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "kind", "line", "end_line", "methods", "signature"))), lambda x: x.dropFields("pos")).alias("symbols"))
        imports = self.imports.where(F.col("path") == path).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), 1, 12).alias("imports"))
        dependents = self.deps.where(F.col("dst") == path).agg(F.slice(F.array_sort(F.collect_set("src")), 1, 20).alias("dependent_paths"))
        tests = self.tests(F.col("path") == path).agg(F.array_sort(F.collect_set("test")).alias("tests"))
        out = self.facts().where(F.col("path") == path)
        for one in (symbols, imports, dependents, tests, own(self.side_effects, "label").withColumnRenamed("label", "side_effects")):
            out = out.crossJoin(F.broadcast(one))  # each is one row of one file
        return out

    def flow(self, path: str, count: int = 6, least: int = 4, lines: int = 40) -> DataFrame:
        size = F.col("end_line") - F.col("line") + 1
        top = self.symbols.where((F.col("path") == path) & F.col("kind").isin("function", "method") & (size >= least)).withColumn("size", size).orderBy(F.desc("size"), "path", "pos").limit(count)
        kept = F.slice(F.filter(F.slice(S.lines(F.col("text")), F.col("line"), F.col("size")), lambda x: F.trim(x) != ""), 1, lines)
        return top.join(self.files.select("path", "text"), "path").select("path", "name", "line", "end_line", "size", F.array_join(kept, "\n").alias("body")).orderBy(F.desc("size"), "line")

    def search(self, query: str, per_file: int = 5) -> DataFrame:
        return text.search(text.line_table(self.files.where("not is_test")), query, per_file)

    def symbol(self, name: str, callers: int = 30) -> DataFrame:
        """Definitions, callers (in files that depend on a definition's, or in its own but for classes) and likely tests as rows with
        `relation`; of a name without a definition the first 20 lines that hold it, as `text match`."""
        found = self.find(name).select("path", F.col("line").cast("long").alias("line"), F.coalesce(F.nullif("signature", F.lit("")), F.concat_ws(" ", "kind", "name")).alias("text"), "kind")
        row = lambda df, relation: df.select(F.lit(relation).alias("relation"), "path", "line", "text")
        if found.isEmpty():
            return row(self.search(name, 20).orderBy("path", "line").limit(20).withColumn("text", S.strip(F.col("text"))), "text match")
        scope = self.deps.join(found.select(F.col("path").alias("dst")).distinct(), "dst").select(F.col("src").alias("path")).unionByName(found.where("kind <> 'class'").select("path")).distinct()
        uses = graph.without(graph.within(self.references(name), scope), found).orderBy("path", "line").limit(callers)
        tests = self.tests().join(found.select("path").distinct(), "path", "left_semi").select(F.col("test").alias("path")).distinct()
        tests = tests.select("path", F.lit(None).cast("long").alias("line"), F.lit("").alias("text"))
        return row(found, "definition").unionByName(row(uses, "caller")).unionByName(row(tests, "test"))

    def slice(self, name: str, comments: bool = True, signature_only: bool = False) -> DataFrame:
        found = self.find(S_name(name)).where("end_line > 0")
        bare = name.rsplit(".", 1)[-1]
        best = (self.find(bare).where("end_line > 0") if bare != name and found.isEmpty() else found).limit(1)
        body = F.col("signature") if signature_only else S.body(S.lines(F.col("text" if comments else "code")), F.col("line"), F.col("end_line"))
        return best.join(self.files.select("path", "text", "code"), "path").select("path", "name", "line", "end_line", body.alias("body"))

    def uses(self, name: str, include_definitions: bool = False) -> DataFrame:
        """References as path, line, text, and definitions' own lines, too, if asked for."""
        defined = self.find(name).select("path", F.col("line").cast("long").alias("line"))
        rows = graph.without(self.references(name), defined)
        if not include_definitions:
            return rows
        lines = text.line_table(self.files.join(defined.select("path").distinct(), "path", "left_semi"))
        return rows.unionByName(defined.join(lines, ["path", "line"]).select("path", "line", S.strip(F.col("text")).alias("text"))).distinct().orderBy("path", "line")

    def callgraph(self, query: str) -> DataFrame:
        """route -> handler -> called methods -> their file's side effects; of what is no route, its first 20 references with the side
        effects of the file that defines it."""
        handlers = self.routes.where(F.col("route") == query).select("route", "handler")
        at = self.symbols.select(F.col("path").alias("handler_path"), F.col("name").alias("handler"))
        calls = self.calls.select(F.col("path").alias("handler_path"), F.col("symbol").alias("handler"), "class_name", "method_name", "inferred")
        classes = self.symbols.where("kind = 'class'").groupBy(F.col("name").alias("class_name")).agg(F.min_by(F.struct("path", "methods"), F.struct("path", "pos")).alias("c")).select("class_name", F.col("c.path").alias("class_path"), "c.methods")
        effects = self.side_effects.groupBy(F.col("path").alias("class_path")).agg(F.array_sort(F.collect_set("label")).alias("side_effects"))
        if not handlers.isEmpty():
            return graph.call_chain(handlers, at, calls, classes, effects)
        best = self.find(query).limit(1).select(F.col("path").alias("class_path")).join(effects, "class_path", "left")
        return self.references(query).limit(20).crossJoin(F.broadcast(best)).select(F.lit(query).alias("callee"), "path", "line", "text", "class_path", "side_effects")  # best is one row

    def effects_of(self, route: str) -> DataFrame:
        """label: side effects anywhere on a route: in its file, its handler's, and those of the methods that it calls."""
        chain = self.callgraph(route)
        files = self.routes.where(F.col("route") == route).select("path")
        if "handler_path" in chain.columns:
            files = files.unionByName(chain.select(F.col("handler_path").alias("path")))
        files = files.unionByName(chain.select(F.col("class_path").alias("path"))).distinct()
        return self.side_effects.join(files, "path", "left_semi").select("label").distinct().orderBy("label")

    def blame(self, name: str, lines: DataFrame) -> DataFrame:
        """Of a symbol, given the blamed lines of its file: author, lines, per_mille and the last commits."""
        best = self.find(S_name(name)).where("end_line > 0").limit(1).select("path", "line", "end_line")
        own = lines.join(F.broadcast(best), "path").where("line_no between line and end_line")  # best is one row
        return history.ownership(own).join(history.last_touch(own), "path").orderBy(F.desc("lines"), "author")

    def indexed(self, commit_files: DataFrame) -> DataFrame:
        return history.indexed(commit_files, self.files)

    def hot(self, commit_files: DataFrame | None) -> DataFrame:
        """path, commits, hotspot of the files that commits touched."""
        if commit_files is None:
            return self.files.select("path", F.lit(0).cast("long").alias("commits"), F.lit(False).alias("hotspot")).limit(0)
        return history.hotspot_flags(history.churn(self.indexed(commit_files))).select("path", "commits", "hotspot")

    def selected(self, changed: DataFrame | None = None, target: str | None = None) -> DataFrame:
        """What a question is about: the changed paths, where given, else the target."""
        if changed is not None:
            return changed.select("path").distinct()
        return self.files.sparkSession.createDataFrame([(target,)] if target else [], "path string")

    def related(self, chosen: DataFrame, commit_files: DataFrame | None = None) -> DataFrame:
        """All that is known of the chosen paths (path): analyzer, side_effects, findings, dependent_paths, tests, commits, hotspot, and the
        verdicts `risk` and `blast_radius`. A path that the corpus lacks has a null analyzer and empty lists."""
        listed = lambda df, c, name: df.groupBy("path").agg(F.array_sort(F.collect_set(c)).alias(name))
        own = lambda df: df.join(chosen, "path", "left_semi")
        rows = chosen.join(self.files.select("path", "lang", "lines", "analyzer", "precision", "confidence"), "path", "left")
        for part, name in (
            (listed(own(self.side_effects), "label", "side_effects"), "side_effects"), (listed(own(self.findings), "label", "findings"), "findings"),
            (graph.inverse(self.deps.join(chosen.withColumnRenamed("path", "dst"), "dst", "left_semi")), "dependent_paths"), (listed(own(self.tests()), "test", "tests"), "tests"),
        ):
            rows = rows.join(part, "path", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
        rows = rows.join(self.hot(commit_files), "path", "left").fillna(0, ["commits"]).fillna(False, ["hotspot"])
        n, path = F.size("dependent_paths"), F.col("path")
        return rows.withColumn("risk", history.impact_risk(path, n, F.col("hotspot"))).withColumn("blast_radius", history.blast_radius(path, n, F.col("hotspot")))

    def impact(self, chosen: DataFrame, commit_files: DataFrame | None = None) -> DataFrame:
        """Dependents, tests and risk of the chosen paths."""
        return self.related(chosen, commit_files).select("path", "dependent_paths", "tests", "risk", "hotspot", "commits").orderBy("path")

    def preflight(self, path: str, commit_files: DataFrame | None = None) -> DataFrame:
        """What to know before a change of a file of the corpus (else no row): blast radius, co-change neighbors, checks to run."""
        row = self.related(self.files.where(F.col("path") == path).select("path"), commit_files)
        none = F.array().cast("array<struct<path:string,co_changes:bigint>>")
        mates = self.files.sparkSession.range(1).select(none.alias("neighbors"))
        if commit_files is not None:
            top = history.neighbors(self.indexed(commit_files), path, 3)
            mates = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("co_changes")).alias("k"), "path", "co_changes"))), lambda x: x.dropFields("k")).alias("neighbors"))
        symbols = self.symbols.where(F.col("path") == path).agg(F.count("*").alias("symbols"))
        python = F.filter("tests", lambda t: t.endswith(".py"))
        run = F.when(F.size(python) > 0, F.concat(F.lit("pytest "), F.array_join(F.slice(python, 1, 3), " "))).when(F.size("tests") > 0, "run likely related tests")
        checks = F.array_compact(F.array(run, F.when(F.size("findings") > 0, "review security flags before editing"), F.when(F.col("blast_radius") == "HIGH", "inspect dependents and changed callers")))
        checks = F.when(F.size(checks) == 0, F.array(F.lit("run targeted project tests after editing"))).otherwise(checks)
        out = row.crossJoin(F.broadcast(mates)).crossJoin(F.broadcast(symbols))  # each is one row
        return out.select("path", "lang", "lines", S.precision_label(F.col("analyzer")).alias("trust"), "symbols", "dependent_paths", "tests", "side_effects", "findings", "blast_radius", "hotspot", "commits", "neighbors", checks.alias("checks"))

    def changed_symbols(self, base: Corpus, chosen: DataFrame) -> DataFrame:
        """path, changed_symbols (name, change: added, removed, signature) of the chosen paths."""
        change = F.when(F.col("status") == "changed", "signature").otherwise(F.col("status"))
        order = F.when(change == "added", 0).when(change == "removed", 1).otherwise(2)
        rows = self.sdiff(base, chosen).join(self.files.select("path"), "path", "left_semi").select("path", F.struct(order.alias("o"), "name", change.alias("change")).alias("x")).distinct()
        return rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.dropFields("o")).alias("changed_symbols"))

    def review(self, base: Corpus, chosen: DataFrame, commit_files: DataFrame | None = None, security: bool = False) -> DataFrame:
        """The chosen paths with what changed in them since the base, side effects, findings (if asked for), tests and a summary. A path that
        the corpus lacks is there, with a summary that says so."""
        rows = self.related(chosen, commit_files).join(self.changed_symbols(base, chosen), "path", "left")
        changed = F.coalesce("changed_symbols", F.array().cast("array<struct<name:string,change:string>>"))
        bits = F.array_compact(F.array(
            F.when(F.size(changed) > 0, F.concat(F.size(changed).cast("string"), F.lit(" changed symbols"))),
            F.when(F.size("side_effects") > 0, F.concat(F.lit("side effects: "), F.array_join(F.slice("side_effects", 1, 2), ", "))),
            F.when(F.col("hotspot"), F.concat(F.lit("hotspot ("), F.col("commits").cast("string"), F.lit(" commits)"))),
            F.when(F.size("tests") == 0, "no likely tests found"),
        ))
        summary = F.when(F.col("analyzer").isNull(), "not indexed").when(F.size(bits) == 0, "no elevated semantic risk detected").otherwise(F.array_join(bits, "; "))
        findings = F.col("findings") if security else F.array().cast("array<string>")
        return rows.select("path", "analyzer", "precision", "confidence", changed.alias("changed_symbols"), F.col("side_effects").alias("risks"), findings.alias("findings"), "tests", "hotspot", "commits", summary.alias("summary")).orderBy("path")

    def changes(self, base: Corpus, chosen: DataFrame, commit_files: DataFrame | None = None, top_symbols: int = 6, security: bool = False) -> DataFrame:
        """The candidates of a diff pack: the chosen paths that the corpus has, with risk_points and level, riskiest first."""
        review = self.review(base, chosen, commit_files, security).where("analyzer is not null")
        rows = review.withColumn("changed_symbols", F.slice("changed_symbols", 1, max(1, top_symbols))).join(graph.inverse(self.deps), "path", "left")
        rows = rows.withColumn("dependent_paths", F.coalesce("dependent_paths", F.array().cast("array<string>")))
        some = lambda c: (F.size(c) > 0).cast("long")
        points = history.risk_points(F.col("hotspot"), some("risks"), some("findings"), F.size("dependent_paths").cast("long"), some("changed_symbols"), F.size("tests"))
        rows = rows.withColumn("risk_points", points).withColumn("level", history.risk_level(F.col("risk_points")))
        return rows.orderBy(F.desc("risk_points"), F.desc(F.size("changed_symbols")), F.desc(F.size("dependent_paths")), "path")

    def diff_pack(self, base: Corpus, chosen: DataFrame, commit_files: DataFrame | None = None, max_tokens: int = 800, top_symbols: int = 6, security: bool = False) -> DataFrame:
        """The riskiest changes that a rendered text of the budget (at least 80 tokens) holds, in order."""
        rows = self.changes(base, chosen, commit_files, top_symbols, security)
        named = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(title), F.array_join(items, ", ")))
        symbols = F.transform("changed_symbols", lambda x: F.concat_ws(" ", x["change"], x["name"]))
        says = F.array_compact(F.array(named("symbols: ", symbols), named("likely tests: ", F.slice("tests", 1, 4)), named("dependents: ", F.slice("dependent_paths", 1, 4)), named("side effects: ", F.slice("risks", 1, 4)), named("findings: ", F.slice("findings", 1, 4))))
        rank = F.struct(-F.col("risk_points"), -F.size("changed_symbols"), -F.size("dependent_paths"))
        return greedy_pack(rows.select("path", rank.alias("rank"), F.lit("changed").alias("relation"), F.concat(F.lit("risk "), "level").alias("role"), says.alias("says")), max(80, max_tokens))

    def risk(self, churned: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
        """impact, blast_radius, risk_points and level of every file (of the changed ones, where given)."""
        count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
        tests = count(self.tests(), "tests")
        rows = self.facts().select("path", "dependents").join(count(self.side_effects, "effects"), "path", "left").join(count(self.findings, "issues"), "path", "left").join(tests, "path", "left")
        hot = history.hotspot_flags(self.indexed(churned)).select("path", "commits", "hotspot") if churned is not None else self.hot(None)
        rows = rows.join(hot, "path", "left").fillna(0).fillna(False)
        if changed is not None:
            rows = rows.join(changed.select("path").distinct(), "path", "left_semi")
        path, d, h = F.col("path"), F.col("dependents"), F.col("hotspot")
        points = history.risk_points(h, F.col("effects"), F.col("issues"), d, F.lit(int(changed is not None)), F.col("tests"))
        return rows.withColumn("impact", history.impact_risk(path, d, h)).withColumn("blast_radius", history.blast_radius(path, d, h)).withColumn("risk_points", points).withColumn("level", history.risk_level(F.col("risk_points"))).orderBy(F.desc("risk_points"), F.desc("dependents"), "path")

    def api(self, target: str = "") -> DataFrame:
        public = F.filter("methods", lambda m: ~m.startswith("_"))
        rows = self.symbols.where((F.col("kind") != "method") & ~S.bare(F.col("name")).startswith("_")).join(self.files.where("not is_test").select("path"), "path", "left_semi")
        inside = (F.col("path") == target) | F.col("path").startswith(target.rstrip("/") + "/") if target else F.lit(True)
        return rows.where(inside).select("path", "name", "kind", "line", "signature", public.alias("methods")).orderBy("path", "line", "name")

    def sdiff(self, base: Corpus, chosen: DataFrame | None = None) -> DataFrame:
        """Symbols added, removed or changed in signature (of the chosen paths, where given); a repeated name counts by occurrence."""
        nth = F.row_number().over(Window.partitionBy("path", "name").orderBy("pos"))
        own = lambda c: c.symbols if chosen is None else c.symbols.join(chosen, "path", "left_semi")
        side = lambda c: own(c).select("path", "name", nth.alias("occurrence"), "signature")
        return text.snapshot_diff(side(base), side(self), ["path", "name", "occurrence"], "signature")

    def budget(self, target: str = "", top: int = 10) -> DataFrame:
        inside = (F.col("path") == target) | F.col("path").startswith(target.rstrip("/") + "/") if target else F.lit(True)
        return text.largest(self.facts().where(inside), top)

    def pack(self, target: str, commit_files: DataFrame | None = None, max_tokens: int = 800, top_symbols: int = 6) -> DataFrame:
        """Files to read about a target in order (target, likely test, dependent, co-change, search hit), as far as a budget of at
        least 80 tokens goes: a file is taken if the whole text so far and its lines fit, or if it is the first."""
        exact, inside = F.col("path") == target, F.col("path").startswith(target.rstrip("/") + "/")
        named = self.find(target).select("path").distinct()
        tiers = [self.files.where(exact).select("path"), self.files.where(inside).select("path").orderBy("path").limit(12), named, self.search(target).select("path").distinct().orderBy("path").limit(12)]
        chosen, first = None, tiers[0]
        for i, tier in enumerate(tiers):
            row = tier.select("path", F.lit(i).alias("tier"))
            chosen = row if chosen is None else chosen.unionByName(row)
        # the first tier that has rows; each has a few
        first = chosen.join(F.broadcast(chosen.agg(F.min("tier").alias("tier"))), "tier").select("path").distinct()
        related = [first.withColumn("relation", F.lit("target")).withColumn("rank", F.lit(0))]
        tests = self.tests().join(first, "path").select(F.col("test").alias("path"))
        users = self.deps.join(first.select(F.col("path").alias("dst")), "dst").select(F.col("src").alias("path"))
        extra = [("likely-test", tests), ("dependent", users)]
        if commit_files is not None:
            commit_files = self.indexed(commit_files)
            own = commit_files.join(first, "path", "left_semi").select("commit").distinct()
            mates = commit_files.join(own, "commit", "left_semi").join(first, "path", "left_anti").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(3)
            extra.append(("co-change", mates.select("path")))
        extra.append(("search-hit", self.search(target).select("path")))
        related += [df.distinct().withColumn("relation", F.lit(name)).withColumn("rank", F.lit(i + 1)) for i, (name, df) in enumerate(extra)]
        rows = related[0]
        for df in related[1:]:
            rows = rows.unionByName(df)
        ranked = rows.join(self.files.select("path"), "path", "left_semi").groupBy("path").agg(F.min(F.struct("rank", "relation")).alias("r")).select("path", "r.*")
        symbols = self.symbols.where("kind <> 'method'").groupBy("path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "kind", "line"))), lambda x: F.concat_ws(" ", x["kind"], x["name"], F.concat(F.lit("L"), x["line"].cast("string")))), 1, top_symbols).alias("says"))
        ready = ranked.join(symbols, "path", "left").join(self.facts().select("path", "role", "raw_tokens"), "path")
        return greedy_pack(ready, max(80, max_tokens))


def S_name(name: str) -> str:
    """(*T).method as T.method."""
    import re

    return re.sub(r"\(\*?([A-Za-z_]\w*)\)\.", r"\1.", name)


def greedy_pack(rows: DataFrame, budget: int) -> DataFrame:
    """rows (path, rank, relation, role, says) that a rendered text of the budget holds, in order. The cost of a row is that of
    the whole text with it, so the rows, a pack's few candidates, pass through one task that keeps the text so far."""
    schema = "n int, path string, relation string, rendered string, tokens long"

    def run(parts):
        said, n = "", 0
        for part in parts:
            out = []
            for path, relation, role, says in zip(part["path"], part["relation"], part["role"], part["says"], strict=True):
                new = said + f"{path} [{relation}, {role}]\n" + "".join(f"  {s}\n" for s in (says if says is not None else []))
                cost = max(1, len(new) // 4)
                if cost <= budget or not n:
                    out.append((n, path, relation, new[len(said) :], cost))
                    said, n = new, n + 1
            yield pd.DataFrame(out, columns=["n", "path", "relation", "rendered", "tokens"])

    return rows.coalesce(1).sortWithinPartitions("rank", "path").mapInPandas(run, schema)
