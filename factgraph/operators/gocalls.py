"""What calls in Go source mean: functions called, HTTP routes and their handlers, SQL statements and their tables. All by joins.

Every file has said what stands in it (sources/gobody): imports, functions, types, fields, globals, events, uses and calls. What a name stands for where it
is used, its type or its text with the lines of all literals that it is made of, is found in operators/govalues. What is not exact leaves a gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.govalues import DB, MUX, TX, Source, span
from factgraph.plans.materialize import written
from factgraph.sources import sqlref

# The methods that take a statement, and at which place.
SQL_METHODS = {"Query": 0, "QueryContext": 1, "QueryRow": 0, "QueryRowContext": 1, "Exec": 0, "ExecContext": 1}

GAPS = {
    "go_ambiguous_call": "The name called is declared more than once.",
    "go_unresolved_call": "What is called is no exact named function.",
    "go_unresolved_method": "The method's receiver has no exact type of its package.",
    "go_unresolved_route_receiver": "The receiver is not proven to be net/http or its ServeMux; no route is derived.",
    "go_unresolved_sql_receiver": "The receiver is not proven to be a database/sql DB or Tx; no query is derived.",
    "go_route_arguments": "A registration takes two arguments.",
    "go_dynamic_route": "The route's pattern is no constant text.",
    "go_route_pattern": "The route's pattern is not understood.",
    "go_unresolved_handler": "The handler is no exact named function or method; no link is derived.",
    "go_sql_arguments": "The call has no statement among its arguments.",
    "go_dynamic_sql": "The statement is no constant text.",
    "go_unsupported_sql": "The statement is outside the grammar; its tables are left out.",
    "go_evaluation_limit": "A constant exceeds the bounds of evaluation.",
}


def references(texts: DataFrame) -> DataFrame:
    """(value, schema, table, access, operation, error) of distinct statements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sql in batch["value"]:
                try:
                    r = sqlref.recognize(sql)
                    rows.append((sql, r.schema, r.table, r.access, r.operation, ""))
                except sqlref.NotRecognized as e:
                    rows.append((sql, "", "", "", "", str(e)))
            yield pd.DataFrame(rows, columns=["value", "schema", "table", "access", "operation", "error"])

    return texts.select("value").distinct().mapInPandas(run, "value string, schema string, table string, access string, operation string, error string")


class Resolved:
    """assets, edges, gaps, supports and table references, each a DataFrame."""

    def __init__(self, facts: DataFrame, budget: tuple[int, int] | None = None):
        source = Source(facts)
        calls = source.rows.filter("kind = 'call'").select("pkg", "path", F.col("owner").alias("fn"), "locator", "ordinal", F.concat_ws("#", "path", F.col("ordinal").cast("string")).alias("id"), F.col("d.chain").alias("whole"), "d.tail", "d.args", F.when(F.col("d.chain").isNotNull(), F.col("d.first")).alias("first"))
        calls = source.chained(calls.withColumn("chain", F.when(F.size("whole") > 1, F.slice("whole", 1, F.size("whole") - 1)).otherwise(F.col("whole"))))
        calls = calls.withColumn("simple", F.size("whole") == 1).withColumn("method", F.coalesce(F.element_at("whole", -1), "tail")).withColumn("r", F.when(~F.col("simple") & F.col("whole").isNotNull(), F.col("t_chain")))
        calls = self.targets(source, calls, F.when(F.col("simple") & ~F.col("known"), F.col("method")).otherwise(self.method_of(F.col("r"), F.col("method"))))
        vars_ = source.globals.select("pkg", F.col("name").alias("method"), F.lit(True).alias("global"))
        calls = written(calls.join(vars_, ["pkg", "method"], "left"), "go-calls")
        imported = F.coalesce(F.col("r").startswith("pkg:"), F.lit(False))
        exact, many = F.col("target").isNotNull(), F.col("times") > 1
        route = F.col("method").isin("HandleFunc", "Handle") & ~F.coalesce("simple", F.lit(False))
        sql = F.col("method").isin(*SQL_METHODS) & ~F.coalesce("simple", F.lit(False))
        proven_mux, proven_sql = F.coalesce(F.col("r").isin("pkg:net/http", MUX, MUX[1:]), F.lit(False)), F.coalesce(F.col("r").isin(DB, TX), F.lit(False))
        self.edges = [calls.filter(exact).select("path", "locator", F.lit("function").alias("from_kind"), F.col("fn").alias("from_key"), F.lit("function").alias("to_kind"), F.col("target").alias("to_key"), F.lit("calls").alias("type"))]
        code = (
            F.when(many, "go_ambiguous_call")
            .when(exact, None)
            .when(F.col("simple"), F.when(F.col("known") | F.col("global"), "go_unresolved_call"))
            .when(F.col("whole").isNull() & (F.col("tail") == ""), "go_unresolved_call")
            .when(route, F.when(~proven_mux & ~imported, "go_unresolved_route_receiver"))
            .when(sql, F.when(~proven_sql & ~imported, "go_unresolved_sql_receiver"))
            .when(~imported & ~proven_sql & ~F.coalesce(F.col("r") == MUX, F.lit(False)), "go_unresolved_method")
        )
        index = F.when(route, F.lit(0)).otherwise(F.element_at(F.create_map(*(F.lit(x) for m, i in SQL_METHODS.items() for x in (m, i))), F.col("method")))
        stated = calls.filter((route & proven_mux & (F.size("args") == 2)) | (sql & proven_sql)).withColumn("arg", F.get("args", index)).filter("arg is not null")
        self.values, limited = source.texts(stated.select("id", "pkg", "path", "fn", "ordinal", "arg.parts", "arg.line", "arg.last"), budget)
        limited = limited.unionByName(source.limited_types)
        self.gaps = [calls.select("path", "locator", code.alias("code")).filter("code is not null"), limited.select("path", "locator", F.lit("go_evaluation_limit").alias("code"))]
        self.assets, self.supports = [], []
        self.routes(source, calls.filter(route & proven_mux))
        self.queries(source, calls.filter(sql & proven_sql))

    @staticmethod
    def method_of(r: Column, method: Column) -> Column:
        base = F.regexp_extract(r, r"^\*?\$(\w+)$", 1)
        return F.when(base != "", F.concat(base, F.lit("."), method))

    @staticmethod
    def targets(source: Source, df: DataFrame, symbol: Column) -> DataFrame:
        """df with the one function that symbol names, and how many it names; init is never called by name, and a field of a type hides its methods."""
        found = source.functions.select("pkg", F.col("name").alias("symbol"), F.when((F.col("times") == 1) & (F.col("name") != "init"), F.col("key")).alias("target"), "times")
        hidden = source.fields.select("pkg", F.concat("base", F.lit("."), "field").alias("symbol")).distinct()
        return df.withColumn("symbol", symbol).join(found.join(hidden, ["pkg", "symbol"], "left_anti"), ["pkg", "symbol"], "left").drop("symbol")

    def gap(self, df: DataFrame, code: str, locator: Column | None = None) -> None:
        self.gaps.append(df.select("path", (F.col("locator") if locator is None else locator).alias("locator"), F.lit(code).alias("code")))

    def edge(self, df: DataFrame, type_: str, from_kind: str, from_key: str, to_kind: str, to_key: str, locator: Column | None = None) -> None:
        at = F.col("locator") if locator is None else locator
        self.edges.append(df.select("path", at.alias("locator"), F.lit(from_kind).alias("from_kind"), F.col(from_key).alias("from_key"), F.lit(to_kind).alias("to_kind"), F.col(to_key).alias("to_key"), F.lit(type_).alias("type")))

    def asset(self, df: DataFrame, kind: str, name: Column, attributes: Column) -> None:
        self.assets.append(df.select("path", "locator", F.lit(kind).alias("kind"), name.alias("name"), F.col("key").alias("canonical"), attributes.alias("attributes")))
        self.supports.append(df.select(F.lit(kind).alias("kind"), F.col("key").alias("canonical"), F.inline("origins")))

    @staticmethod
    def keyed(df: DataFrame, kind: str) -> DataFrame:
        """Keys hold the function and the place of the call among its file's, so that lines may move."""
        return df.withColumn("key", F.concat(F.lit(f"go_{kind}:"), F.regexp_replace("fn", "^go_function:", ""), F.lit("#"), F.element_at(F.split("id", "#"), -1)))

    def routes(self, source: Source, calls: DataFrame) -> None:
        self.gap(calls.filter("size(args) <> 2"), "go_route_arguments")
        calls = calls.filter("size(args) = 2").withColumn("pattern_arg", F.get("args", F.lit(0))).withColumn("handler_arg", F.get("args", F.lit(1)))
        calls = written(self.keyed(calls.join(self.values, "id", "left"), "route"), "go-routes")
        at = span(F.col("pattern_arg.line"), F.col("pattern_arg.last"))
        self.gap(calls.filter("value is null and not coalesce(limited, false)"), "go_dynamic_route", at)
        method = F.when(F.col("value").rlike(r"[ \t]"), F.regexp_extract("value", r"(?s)^([^ \t]*)[ \t]", 1)).otherwise("")
        path = F.when(F.col("value").rlike(r"[ \t]"), F.regexp_replace("value", r"(?s)^[^ \t]*[ \t]+", "")).otherwise(F.col("value"))
        calls = calls.filter("value is not null").withColumn("http_method", method).withColumn("route_path", path)
        good = F.col("route_path").contains("/") & F.col("http_method").rlike(r"^[A-Za-z0-9!#$%&'*+.^_`|~-]*$") & ~F.col("route_path").rlike(r"[ \t\r\n]")
        self.gap(calls.filter(~good), "go_route_pattern", at)
        calls = calls.filter(good)
        self.asset(calls, "route", F.col("value"), F.create_map(F.lit("pattern"), F.col("value"), F.lit("method"), F.col("http_method"), F.lit("path"), F.col("route_path"), F.lit("registration"), F.col("method")))
        self.edge(calls, "registers", "function", "fn", "route", "key")
        form = F.get("handler_arg.chain", F.lit(0))
        wrapped, literal = F.coalesce(form == "()", F.lit(False)), F.coalesce(form == "{}", F.lit(False))
        chain = F.when(wrapped, F.slice("handler_arg.chain", 4, 1 << 10)).when(~literal, F.col("handler_arg.chain"))
        h = calls.select("pkg", "path", "fn", "key", "id", F.col("handler_arg.first").alias("first"), F.col("method").alias("registration"), F.col("handler_arg"), wrapped.alias("wrapped"), F.when(literal, F.get("handler_arg.chain", F.lit(1))).alias("text"), chain.alias("passed"))
        h = source.typed(h).withColumnRenamed("t", "literal_type")
        h = source.chained(h.withColumn("whole", F.col("passed")).withColumn("chain", F.when(F.size("passed") > 1, F.slice("passed", 1, F.size("passed") - 1)).otherwise(F.col("passed"))))
        direct = F.when((F.size("passed") == 1) & ~F.col("known"), F.get("passed", F.lit(0))).otherwise(F.when(F.size("passed") > 1, self.method_of(F.col("t_chain"), F.element_at("passed", -1))))
        h = self.targets(source, h, direct).withColumnRenamed("target", "direct").drop("times")
        t = F.coalesce("literal_type", F.when(F.size("passed") == 1, F.col("t_chain")))
        h = self.targets(source, h.withColumn("t", t), self.method_of(F.col("t"), F.lit("ServeHTTP"))).withColumnRenamed("target", "serves").drop("times")
        params = source.rows.filter("kind = 'function'").select("pkg", "path", F.col("owner").alias("serves"), "d.pointer", "d.results", F.posexplode("d.params").alias("at", "text"))
        params = source.typed(params).groupBy("serves").agg(F.first("pointer").alias("pointer"), F.first("results").alias("results"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("t", F.lit("")).alias("t")))), lambda x: x["t"]), ",").alias("types"))
        h = h.join(params, "serves", "left")
        served = (F.col("types") == "net/http.ResponseWriter,*net/http.Request") & (F.size("results") == 0) & (~F.col("pointer") | F.col("t").startswith("*"))
        h = h.withColumn("handler", F.when((F.col("registration") == "HandleFunc") | F.col("wrapped"), F.col("direct")).when(served, F.col("serves")))
        h = written(h.select("path", span(F.col("handler_arg.line"), F.col("handler_arg.last")).alias("locator"), "key", "handler"), "go-handlers")
        self.edge(h.filter("handler is not null"), "handles", "route", "key", "function", "handler")
        self.gap(h.filter("handler is null"), "go_unresolved_handler")

    def queries(self, source: Source, calls: DataFrame) -> None:
        index = F.element_at(F.create_map(*(F.lit(x) for m, i in SQL_METHODS.items() for x in (m, i))), F.col("method"))
        self.gap(calls.filter(F.size("args") <= index), "go_sql_arguments")
        calls = calls.filter(F.size("args") > index).withColumn("arg", F.get("args", index))
        calls = self.keyed(calls.join(self.values, "id", "left"), "query").withColumn("arg_locator", span(F.col("arg.line"), F.col("arg.last")))
        calls = written(calls, "go-queries")
        self.gap(calls.filter("value is null and not coalesce(limited, false)"), "go_dynamic_sql", F.col("arg_locator"))
        calls = calls.filter("value is not null")
        read = written(calls.join(references(calls), "value"), "go-statements")
        attributes = F.when(F.col("error") == "", F.create_map(*(x for c in ("method", "operation", "schema", "table", "access") for x in (F.lit(c), F.col(c))))).otherwise(F.create_map(F.lit("method"), F.col("method")))
        self.asset(read, "query", F.col("method"), attributes)
        self.edge(read, "queries", "function", "fn", "query", "key")
        self.gap(read.filter("error <> ''"), "go_unsupported_sql", F.col("arg_locator"))
        self.tables = read.filter("error = ''").select("path", F.col("arg_locator").alias("locator"), F.col("key").alias("query"), "schema", "table", "access", "origins")


def resolved(facts: DataFrame, budget: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The facts with those that the Go files' calls mean, and their references to tables (path, locator, query, schema, table, access, origins).

    budget: the steps and bytes that all evaluations may take together, as in the scan of a project."""
    found = Resolved(facts, budget)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    ordinal = lambda df, *order: df.withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy(*order)) + (1 << 30))  # noqa: E731  after what the files say themselves
    assets = ordinal(union(found.assets), "canonical", "locator").withColumn("fact", F.lit("asset"))
    edges = union(found.edges).select("path", "locator", "from_kind", F.col("from_key").alias("from_canonical"), "to_kind", F.col("to_key").alias("to_canonical"), "type", F.lit("source-derived").alias("origin"), F.lit("edge").alias("fact"))
    messages = F.element_at(F.create_map(*(F.lit(x) for pair in GAPS.items() for x in pair)), F.col("code"))
    gaps = union(found.gaps).select("path", "locator", F.lit("gap").alias("fact"), F.col("code").alias("kind"), messages.alias("name"))
    supports = union(found.supports).select("path", "locator", "kind", "canonical", F.lit("support").alias("fact"))
    made = assets.unionByName(ordinal(edges, "from_canonical", "to_canonical", "type", "locator"), allowMissingColumns=True).unionByName(gaps.distinct(), allowMissingColumns=True).unionByName(supports.distinct(), allowMissingColumns=True)
    return facts.filter("fact <> 'go'").unionByName(made, allowMissingColumns=True), found.tables
