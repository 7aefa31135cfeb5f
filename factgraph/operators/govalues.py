"""What names in Go source stand for: types and texts, found by joins over what every file has said (sources/gobody).

A use of a name meets the innermost declaration that is seen where it stands: an interval join. Of that name's events it sees the latest one that runs
wherever the use does, those after it that may have run, and those that a loop or a function literal may bring back; a type or text is believed only where
all of them agree. So straight lines, branches and scopes need no interpreter: which events a use may meet is settled by their places alone, once.

Types and texts then spread along those links, each round joining only what the round before has found with what waits for it, until nothing is found.
Names that only stand for another name are followed by pointer jumping, in rounds that are the logarithm of their number. What exceeds the bounds of an
evaluation is limited, and so is all that is made of it. What is part of a circle is never found, and stays unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from factgraph.plans.materialize import Grown, written
from factgraph.plans.prefix import running

PART = "struct<text:string,name:string,line:int,last:int,at:int>"
DETAIL = (
    f"type string, alias boolean, generic boolean, pointer boolean, params array<string>, results array<string>, parts array<{PART}>, chain array<string>, tail string, first int, "
    f"args array<struct<parts:array<{PART}>,chain:array<string>,first:int,line:int,last:int>>, line int, last int, nth int, "
    "at int, until int, `from` int, `to` int, closure int, declares boolean, opaque boolean, later array<struct<since:int,first:int,last:int>>"
)
ORIGINS = "array<struct<path:string,locator:string>>"

# What is known of two packages, and the bounds of an evaluation.
MUX, DB, TX = "*net/http.ServeMux", "*database/sql.DB", "*database/sql.Tx"
MOST_DEPTH, MOST_TEXT, MOST_ORIGINS = 128, 64 << 10, 128
MOST_STEPS, MOST_BYTES = 200_000, 8 << 20
#: Rounds of pointer jumping that reach beyond MOST_DEPTH.
JUMPS = MOST_DEPTH.bit_length()


def span(line: Column, last: Column) -> Column:
    return F.format_string("L%d-L%d", line, last)


def node(kind: str, *parts: str | Column) -> Column:
    return F.concat_ws("\n", F.lit(kind), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))


def jumped(step: DataFrame, name: str) -> DataFrame:
    """(node, to, hops, stars) of (node, to, hops, stars): where following the steps ends, or over MOST_DEPTH hops further on."""
    found = Grown(step, name)
    table = found.all()
    for _ in range(JUMPS if found.new else 0):
        on = table.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("hops").alias("more"), F.col("stars").alias("added"))
        moved = table.join(on, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.concat("stars", F.coalesce("added", F.lit(""))).alias("stars"), F.col("beyond").isNotNull().alias("moved"))
        seen = Observation()
        table = written(moved.observe(seen, F.count_if("moved").alias("n")), name).drop("moved")
        if not seen.get["n"]:
            break
    return table


class Source:
    """All that the files of a scan say, as tables that lookups join with."""

    def __init__(self, facts: DataFrame):
        rows = facts.filter("fact = 'go'").select("path", F.col("from_canonical").alias("pkg"), "kind", "name", F.col("canonical").alias("owner"), "locator", "ordinal", F.from_json("detail", DETAIL).alias("d"))
        self.rows = written(rows, "go-rows")
        of = lambda kind: self.rows.filter(F.col("kind") == kind)
        once = lambda df, *key: df.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), *(F.min_by(c, F.struct("path", "ordinal") if "path" in df.columns and "path" not in key else F.col("ordinal")).alias(c) for c in df.columns if c not in (*key, "ordinal")))
        self.imports = once(of("import").select("path", "name", F.col("owner").alias("imported"), "ordinal"), "path", "name").withColumn("imported", F.when(F.col("times") == 1, F.col("imported"))).drop("times")
        self.functions = once(of("function").select("pkg", "name", F.col("owner").alias("key"), "path", "d", "ordinal"), "pkg", "name")
        self.globals = once(of("var").unionByName(of("const")).select("pkg", "name", "path", "kind", "d", "ordinal"), "pkg", "name")
        self.longest = self.rows.agg(F.max(F.greatest(F.size("d.chain"), F.size(F.split("d.type", r"\.")), F.array_max(F.transform("d.args", lambda a: F.size(a["chain"]))))).alias("n")).first().n or 0
        types = once(of("type").select("pkg", "name", "path", "d", "ordinal"), "pkg", "name").filter("times = 1 and not coalesce(d.generic, false)")
        self.types, self.limited_types = self.aliased(types)
        fields = once(of("field").select("pkg", "path", F.col("owner").alias("base"), "name", F.col("d.type").alias("text"), "ordinal"), "pkg", "base", "name").filter("times = 1")
        self.fields = written(self.typed(fields).select("pkg", "base", F.col("name").alias("field"), F.col("t").alias("field_type")), "go-fields")
        results = self.functions.filter("times = 1").select("pkg", F.col("name").alias("called"), "path", F.posexplode("d.results").alias("nth", "text"))
        self.results = written(self.typed(results).select("pkg", "called", "nth", F.col("t").alias("result_type")), "go-results")
        self.met()
        self.spread_types()

    # Types as they are written.

    def named(self, df: DataFrame) -> DataFrame:
        """df with the stars, the imported package if there is one, and the last name of the type that text names in its file."""
        bare = F.regexp_replace("text", r"^\*+", "")
        parts = df.withColumn("stars", F.regexp_extract("text", r"^(\**)", 1)).withColumn("qualifier", F.when(bare.contains("."), F.split(bare, r"\.")[0])).withColumn("base_name", F.element_at(F.split(bare, r"\."), -1))
        return parts.join(self.imports.select("path", F.col("name").alias("qualifier"), "imported"), ["path", "qualifier"], "left")

    def aliased(self, types: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pkg, name, same) of all types, same being what an alias stands for and $name for others; and the (path, locator) of aliases that lead too far."""
        alias = self.named(types.filter("d.alias").select("pkg", "name", "path", F.col("d.type").alias("text"), "d.line", "d.last")).withColumn("node", node("t", "pkg", "name"))
        here = types.select("pkg", "name", F.when(F.col("d.alias"), None).otherwise(F.concat(F.lit("$"), "name")).alias("same"))
        ends = here.filter("same is not null").select("pkg", "name", "same").unionByName(alias.filter("imported is not null").select("pkg", "name", F.concat("stars", "imported", F.lit("."), "base_name").alias("same")))
        step = alias.filter("qualifier is null and base_name <> ''").join(types.select("pkg", F.col("name").alias("base_name")), ["pkg", "base_name"])
        step = step.select("node", node("t", "pkg", "base_name").alias("to"), F.lit(1).alias("hops"), "stars")
        far = jumped(step, "go-aliases")
        found = far.filter(F.col("hops") <= MOST_DEPTH).join(ends.select(node("t", "pkg", "name").alias("to"), "same"), "to").select("node", F.concat("stars", "same").alias("same"))
        through = alias.select("pkg", "name", "node").join(found, "node").select("pkg", "name", "same")
        limited = alias.join(far.filter(F.col("hops") > MOST_DEPTH).select("node"), "node").select("path", span(F.col("line"), F.col("last")).alias("locator"))
        return written(ends.unionByName(through), "go-types"), limited

    def typed(self, df: DataFrame) -> DataFrame:
        """df with t, the type that text names in its file: an imported one by its package's path, one of the package after $; an alias stands for its type."""
        parts = self.named(df).join(self.types.withColumnRenamed("name", "base_name"), ["pkg", "base_name"], "left")
        t = F.when(F.col("text") == "func", "func").when(F.col("imported").isNotNull(), F.concat("stars", "imported", F.lit("."), "base_name")).when(F.col("qualifier").isNull(), F.concat("stars", "same"))
        return parts.withColumn("t", t).drop("stars", "qualifier", "base_name", "imported", "same")

    # Which events a use meets.

    def met(self) -> None:
        """declared: (fn, at, since) of uses with their declaration; met: (fn, at, name, event_at, opaque) of the events that each may see."""
        events = self.rows.filter("kind = 'event'").select("pkg", "path", F.col("owner").alias("fn"), "name", "d.at", "d.until", F.col("d.from").alias("lo"), F.col("d.to").alias("hi"), "d.closure", "d.declares", "d.opaque", "d.type", "d.parts", "d.nth", "d.first")
        uses = self.rows.filter("kind = 'use'").select(F.col("owner").alias("fn"), "name", "d.at", "d.later")
        seen = events.filter("declares").select("fn", "name", F.col("at").alias("since"), "until")
        innermost = lambda df: df.join(seen, ["fn", "name"]).filter("since < at and at < until").groupBy("fn", "name", "at").agg(F.max("since").alias("since"))
        self.declared = written(innermost(uses), "go-declared")
        sets = innermost(events.filter("not declares").select("fn", "name", "at").distinct())
        own = events.filter("declares").withColumn("since", F.col("at")).unionByName(events.filter("not declares").join(sets, ["fn", "name", "at"]))
        self.events = written(own, "go-events")
        e = self.events.select("fn", "name", "since", F.col("at").alias("event_at"), "lo", "hi", "closure", "opaque")
        pairs = uses.join(self.declared, ["fn", "name", "at"]).join(e, ["fn", "name", "since"])
        whole = (F.col("event_at") < F.col("at")) & (F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")) & ~F.col("opaque")
        last = F.max(F.when(whole, F.col("event_at"))).over(Window.partitionBy("fn", "name", "at"))
        anywhere = F.col("opaque") | F.coalesce(F.col("since") < F.col("closure"), F.lit(False))
        again = F.exists("later", lambda x: (x["since"] > F.col("latest")) & (x["first"] <= F.col("event_at")) & (F.col("event_at") < x["last"]))
        pairs = pairs.withColumn("latest", last)
        meets = anywhere | ((F.col("event_at") >= F.col("latest")) & (F.col("event_at") < F.col("at"))) | again
        self.meets = written(pairs.filter(meets).select("fn", "at", "name", "event_at", "opaque"), "go-met")

    # Types by rounds.

    def spread_types(self) -> None:
        """event_types: (fn, name, at, t) of all events that are settled, package variables among them; use_types: (fn, at, own_type) of declared uses."""
        columns = ["pkg", "path", "fn", "name", "at", "text", "nth", "first"]
        variables = self.globals.filter("kind = 'var' and times = 1").select("pkg", "path", node("v", "pkg").alias("fn"), "name", F.lit(-1).alias("at"), F.col("d.type").alias("text"), "d.nth", F.lit(None).cast("int").alias("first"))
        events = self.events.filter("not opaque").withColumnRenamed("type", "text").select(*columns).unionByName(variables)
        waits = F.col("text").rlike("^(call|read) ")
        settled = self.typed(events.filter(~F.coalesce(waits, F.lit(False)))).select("fn", "name", "at", "t")
        waiting = events.filter(waits).withColumn("whole", F.split(F.substring("text", 6, 1 << 20), r"\.")).withColumn("calls", F.col("text").startswith("call "))
        waiting = self.first_of(waiting.withColumn("id", node("w", "fn", "name", "at")))
        waits = Grown(waiting, "go-waiting")
        waiting = waits.all()
        links = waiting.filter("own").select("id", "fn", F.col("first").alias("use_at")).join(self.meets.filter("not opaque").select("fn", F.col("at").alias("use_at"), F.col("name").alias("of_name"), F.col("event_at").alias("of_at")), ["fn", "use_at"])
        links = links.select("id", F.col("fn").alias("of_fn"), "of_name", "of_at").unionByName(waiting.filter("variable").select("id", node("v", "pkg").alias("of_fn"), F.col("first_name").alias("of_name"), F.lit(-1).alias("of_at")))
        types = Grown(settled, "go-event-types")
        if waits.new:
            links = written(links.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id"))), "go-links")
            alone = waiting.join(links.select("id").distinct(), "id", "left_anti").withColumn("first_type", F.col("start"))
            types.add(self.read_or_called(alone))
            came = Grown(self.arrived(links, types.all()), "go-came")
            while came.new:
                ready = came.all().groupBy("id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.collect_set(F.coalesce("t", F.lit(""))).alias("all")).filter("n = k")
                ready = ready.join(types.all().select(node("w", "fn", "name", "at").alias("id")), "id", "left_anti").select("id", F.when(F.size("all") == 1, F.element_at("all", 1)).alias("first_type"))
                if not types.add(self.read_or_called(waiting.join(ready, "id"))):
                    break
                came.add(self.arrived(links, types.last()))
        self.event_types = types.all()
        sees = self.meets.filter("not opaque").join(self.event_types.select("fn", "name", F.col("at").alias("event_at"), F.coalesce("t", F.lit("")).alias("t")), ["fn", "name", "event_at"], "left")
        one = sees.groupBy("fn", "at").agg(F.collect_set(F.coalesce("t", F.lit(""))).alias("all"))
        self.use_types = written(one.select("fn", "at", F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise("").alias("own_type")), "go-use-types")
        self.var_types = self.event_types.filter("at = -1 and fn like 'v\n%'").select(F.substring("fn", 3, 1 << 20).alias("pkg"), F.col("name").alias("first_name"), F.col("t").alias("var_type"))

    @staticmethod
    def arrived(links: DataFrame, types: DataFrame) -> DataFrame:
        return links.join(types.select(F.col("fn").alias("of_fn"), F.col("name").alias("of_name"), F.col("at").alias("of_at"), "t"), ["of_fn", "of_name", "of_at"]).select("id", "n", "t")

    def first_of(self, df: DataFrame) -> DataFrame:
        """df with first_name, own (it is declared in the function), start (pkg: and the path of an import) and variable (it is one of the package)."""
        df = df.withColumn("first_name", F.get("whole", F.lit(0)))
        df = df.join(self.declared.select("fn", F.col("at").alias("first"), F.lit(True).alias("own")), ["fn", "first"], "left").join(self.imports.select("path", F.col("name").alias("first_name"), F.concat(F.lit("pkg:"), "imported").alias("start"), F.lit(True).alias("imports")), ["path", "first_name"], "left")
        df = df.join(self.globals.filter("kind = 'var' and times = 1").select("pkg", F.col("name").alias("first_name"), F.lit(True).alias("variable")), ["pkg", "first_name"], "left")
        own, imports = F.coalesce("own", F.lit(False)), F.coalesce("imports", F.lit(False))
        return df.withColumns({"own": own, "start": F.when(~own, F.col("start")), "variable": F.coalesce("variable", F.lit(False)) & ~own & ~imports}).drop("imports")

    def along(self, df: DataFrame) -> DataFrame:
        """df (id, pkg, chain, first_type) with t_chain, the type at the end of its chain. Chains that are still open take a step a round; the plan of a round has one size."""
        df = df.withColumn("t_chain", F.when(F.size("chain") > 0, F.col("first_type")))
        if self.longest <= 3:
            return self.step(self.step(df, 1), 2)
        open_ = written(df.select("id", "pkg", "chain", "t_chain"), "go-open")
        closed = Grown(open_.filter("size(chain) <= 1").select("id", "t_chain"), "go-closed")
        for i in range(1, self.longest):
            open_ = written(self.step(open_.filter(F.size("chain") > i), i), "go-open")
            closed.add(open_.filter(F.size("chain") == i + 1))
        return df.drop("t_chain").join(closed.all(), "id", "left")

    def step(self, df: DataFrame, i: int) -> DataFrame:
        df = df.withColumn("base", F.regexp_extract("t_chain", r"^\*?\$(\w+)$", 1)).withColumn("field", F.get("chain", F.lit(i))).join(self.fields, ["pkg", "base", "field"], "left")
        default = (F.col("t_chain") == "pkg:net/http") & (F.col("field") == "DefaultServeMux")
        return df.withColumn("t_chain", F.when(F.col("field").isNull(), F.col("t_chain")).when(default, MUX).otherwise(F.col("field_type"))).drop("base", "field", "field_type")

    def read_or_called(self, df: DataFrame) -> DataFrame:
        """(fn, name, at, t) of events that read or call the names in whole, of which the first has first_type."""
        df = df.withColumn("chain", F.when(F.col("calls"), F.slice("whole", 1, F.size("whole") - 1)).otherwise(F.col("whole")))
        df = self.along(df).withColumn("last", F.element_at("whole", -1))
        made = F.col("nth") == 0
        known = F.when(made & (F.col("t_chain") == "pkg:net/http") & (F.col("last") == "NewServeMux"), MUX).when(made & (F.col("t_chain") == "pkg:database/sql") & F.col("last").isin("Open", "OpenDB"), DB).when(made & (F.col("t_chain") == DB) & F.col("last").isin("Begin", "BeginTx"), TX)
        base = F.regexp_extract("t_chain", r"^\*?\$(\w+)$", 1)
        called = F.when(F.size("whole") > 1, F.when(base != "", F.concat(base, F.lit("."), "last"))).when(~F.col("own"), F.col("last"))
        df = df.withColumn("called", F.when(F.col("calls"), called)).join(self.results, ["pkg", "called", "nth"], "left")
        t = F.when(F.col("calls"), F.coalesce(known, "result_type")).otherwise(F.when(~F.coalesce(F.col("t_chain").startswith("pkg:"), F.lit(False)), F.col("t_chain")))
        return df.select("fn", "name", "at", t.alias("t"))

    def chained(self, df: DataFrame) -> DataFrame:
        """df (id, fn, path, pkg, first, whole, chain) with t_chain, the type of chain, or pkg: and the path of an import; and known, whether its first name is one of the function."""
        df = self.first_of(df).join(self.use_types.withColumnRenamed("at", "first"), ["fn", "first"], "left").join(self.var_types, ["pkg", "first_name"], "left")
        first = F.when(F.col("own"), F.col("own_type")).otherwise(F.coalesce("start", F.when(F.col("variable"), F.col("var_type"))))
        return self.along(df.withColumn("first_type", first)).withColumnRenamed("own", "known").drop("first_type", "own_type", "start", "variable", "var_type", "first_name")

    # Texts by rounds.

    def terms(self, df: DataFrame) -> DataFrame:
        """(node, mode, n, i, text, origins, child) of expressions (node, pkg, path, fn, parts): literals, and names as the nodes that they stand for."""
        t = df.select("node", "pkg", "path", "fn", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part")).withColumn("name", F.col("part.name")).withColumn("at", F.col("part.at"))
        t = t.join(self.declared.select("fn", "at", F.lit(True).alias("own")), ["fn", "at"], "left")
        constants = self.globals.filter("kind = 'const' and times = 1 and d.parts is not null").select("pkg", "name", F.lit(True).alias("constant"))
        t = t.join(constants, ["pkg", "name"], "left")
        child = F.when(F.col("name").isNotNull(), F.when(F.col("own"), node("u", "fn", "at")).when(F.col("constant"), node("c", "pkg", "name")))
        origins = F.when(F.col("name").isNull(), F.array(F.struct("path", span(F.col("part.line"), F.col("part.last")).alias("locator"))))
        return t.select("node", F.lit("sum").alias("mode"), "n", "i", F.when(F.col("name").isNull(), F.col("part.text")).alias("text"), origins.cast(ORIGINS).alias("origins"), child.alias("child"))

    def texts(self, asked: DataFrame, budget: tuple[int, int] | None) -> tuple[DataFrame, DataFrame]:
        """(id, value, origins, limited) of asked expressions (id, pkg, path, fn, ordinal, parts, line, last), and the (path, locator) of what exceeds a bound.

        budget: steps and bytes of all evaluations together, in the order of paths and places; what comes after they are spent is limited.
        """
        constants = self.globals.filter("kind = 'const' and times = 1 and d.parts is not null").select(node("c", "pkg", "name").alias("node"), "pkg", "path", F.lit(None).cast("string").alias("fn"), "d.parts")
        events = self.events.filter("parts is not null").select(node("e", "fn", "name", "at").alias("node"), "pkg", "path", "fn", "parts")
        args = asked.filter("parts is not null").select(node("a", "id").alias("node"), "pkg", "path", "fn", "parts")
        made = written(self.terms(constants.unionByName(events).unionByName(args)), "go-terms")
        read = made.filter("child like 'u\n%'").select(F.col("child").alias("node")).distinct()
        sees = self.meets.select(node("u", "fn", "at").alias("node"), F.when(~F.col("opaque"), node("e", "fn", "name", "event_at")).alias("child")).join(read, "node")
        sees = sees.join(events.select(F.col("node").alias("child"), F.lit(True).alias("there")), "child", "left").withColumn("child", F.when(F.col("there"), F.col("child")))
        by = Window.partitionBy("node")
        sees = sees.select("node", F.lit("same").alias("mode"), F.count(F.lit(1)).over(by).cast("int").alias("n"), F.row_number().over(by.orderBy("child")).alias("i"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(ORIGINS).alias("origins"), "child")
        terms = written(made.unionByName(sees), "go-all-terms")
        copies = jumped(terms.filter("n = 1 and child is not null").select("node", F.col("child").alias("to"), F.lit(1).alias("hops"), F.lit("").alias("stars")), "go-copies").drop("stars")
        kept = terms.join(copies.select("node"), "node", "left_anti")
        links = kept.filter("child is not null").join(copies.select(F.col("node").alias("child"), "to", "hops"), "child", "left").select("node", "mode", "n", "i", F.coalesce("to", "child").alias("child"), F.coalesce("hops", F.lit(0)).alias("hops"))
        links = written(links, "go-text-links")
        fixed = kept.filter("child is null").select("node", "mode", "n", "i", "text", "origins", F.lit(0).alias("depth"), F.lit(False).alias("limited"))
        came = Grown(fixed, "go-text-came")
        done = Grown(self.joined(came.all()), "go-texts")
        while done.new:
            carried = links.join(done.last().select(F.col("node").alias("child"), "text", "origins", "depth", "limited"), "child")
            if not came.add(carried.withColumn("depth", F.col("depth") + F.col("hops"))):
                break
            done.add(self.joined(came.all().join(done.all().select("node"), "node", "left_anti")))
        values = done.all()
        deep = copies.filter(F.col("hops") > MOST_DEPTH).select("node", F.lit(True).alias("deep"))
        whole = asked.withColumn("node", node("a", "id")).join(copies, "node", "left").withColumn("of", F.coalesce("to", "node")).join(deep, "node", "left")
        whole = whole.join(values.select(F.col("node").alias("of"), "text", F.col("origins").alias("found"), "limited", "depth"), "of", "left")
        too_deep = F.coalesce("deep", F.lit(False)) | F.coalesce(F.col("depth") + F.coalesce("hops", F.lit(0)) > MOST_DEPTH, F.lit(False))
        whole = whole.withColumn("limited", F.coalesce("limited", F.lit(False)) | too_deep)
        if budget is not None:
            costs = whole.select("id", "path", "ordinal", (F.size("parts") + 1).alias("steps"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
            spent = running(costs, ["path", "ordinal"], {"steps": "all_steps", "bytes": "all_bytes"})
            whole = whole.join(spent.select("id", ((F.col("all_steps") > budget[0]) | (F.col("all_bytes") > budget[1])).alias("spent")), "id").withColumn("limited", F.col("limited") | F.col("spent"))
        whole = written(whole.select("id", "path", "line", "last", F.when(~F.col("limited"), F.col("text")).alias("value"), F.col("found").alias("origins"), "limited"), "go-values")
        lines = self.globals.filter("kind = 'const'").select(node("c", "pkg", "name").alias("node"), "path", F.array_min("d.parts.line").alias("line"), F.array_max("d.parts.last").alias("last"))
        first = values.filter("limited and first_limited").join(lines, "node").select("path", span(F.col("line"), F.col("last")).alias("locator"))
        further = copies.filter(F.col("hops") == MOST_DEPTH + 1).join(lines, "node").select("path", span(F.col("line"), F.col("last")).alias("locator"))
        return whole.select("id", "value", "origins", "limited"), first.unionByName(further).unionByName(whole.filter("limited").select("path", span(F.col("line"), F.col("last")).alias("locator"))).distinct()

    @staticmethod
    def joined(came: DataFrame) -> DataFrame:
        """(node, text, origins, depth, limited, first_limited) of the nodes all of whose terms are there: their sum, or what all of them are."""
        found = came.groupBy("node", "mode").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "text", "origins", "depth", "limited"))).alias("all")).filter("size(all) = n")
        inherited, unknown = F.exists("all", lambda x: x["limited"]), F.exists("all", lambda x: x["text"].isNull())
        alike = F.size(F.array_distinct(F.transform("all", lambda x: x["text"]))) == 1
        text = F.when(F.col("mode") == "sum", F.array_join(F.transform("all", lambda x: x["text"]), "")).when(alike, F.col("all")[0]["text"])
        origins = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["origins"], F.array().cast(ORIGINS))))))
        depth = F.array_max(F.transform("all", lambda x: x["depth"])) + 1
        found = found.select("node", F.when(~unknown, text).alias("text"), origins.alias("origins"), depth.alias("depth"), inherited.alias("inherited"))
        beyond = F.coalesce(F.octet_length("text") > MOST_TEXT, F.lit(False)) | (F.size("origins") > MOST_ORIGINS) | (F.col("depth") > MOST_DEPTH)
        limited = F.col("inherited") | beyond
        return found.select("node", F.when(~limited, F.col("text")).alias("text"), F.when(limited, F.array().cast(ORIGINS)).otherwise(F.col("origins")).alias("origins"), "depth", limited.alias("limited"), (beyond & ~F.col("inherited")).alias("first_limited"))
