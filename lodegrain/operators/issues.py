"""Issues as data: rewriting within a row, and analysis over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from ..plans.compile import empty, issue  # noqa: F401


def pointer(path: Column) -> Column:
    """Segments joined by slashes, each with one before it; empty at the root. Segments are not escaped."""
    return F.when(F.size(path) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(path, "/")))


def listed(issues: Column) -> Column:
    """JSON list of objects with path, code, message and meta."""
    one = lambda i: F.concat(
        F.regexp_replace(F.to_json(F.struct(pointer(i["path"]).alias("path"), i["code"].alias("code"), i["message"].alias("message"))), r"\}\z", ""),
        F.lit(',"meta":'), i["meta"], F.lit("}"),
    )
    return F.concat(F.lit("["), F.array_join(F.transform(issues, one), ","), F.lit("]"))


to_json_list = listed


def is_empty(issues: Column) -> Column:
    return F.size(issues) == 0


def add(issues: Column, one: Column) -> Column:
    return F.array_append(issues, one)


def merge(first: Column, second: Column) -> Column:
    """All of first, then all of second, repeats included."""
    return F.concat(first, second)


def rebase(issues: Column, *prefix: str) -> Column:
    """Issues with segments put before their paths."""
    return F.transform(issues, lambda i: i.withField("path", F.concat(F.array(*(F.lit(p) for p in prefix)), i["path"])))


def with_custom_message(one: Column, message: str) -> Column:
    return one.withField("message", F.lit(message)).withField("custom_message", F.lit(True))


def resolve(issues: Column, resolver: messages.Resolver | None = None, locale: str | None = None) -> Column:
    """Issues with messages by a resolver or locale; those with messages of their own keep them, and all are then fixed."""
    r = resolver or messages.for_locale(locale)

    def one(i: Column) -> Column:
        text = F.when(i["custom_message"], i["message"]).otherwise(r(i["code"], i["meta"]))
        return i.withField("message", text).withField("custom_message", F.lit(True))

    return F.transform(issues, one)


def each(rows: DataFrame, name: str = "i") -> DataFrame:
    """The rows of an outer explode that have an issue. A plain explode makes Spark push `size(issues) > 0`
    below the stages, with all that they bind written out and run once more for each mention."""
    return rows.filter(F.col(name).isNotNull())


def exploded(frame: DataFrame, keys: list[str], issues: str = "issues") -> DataFrame:
    """One row an issue: keys, pos (its place in the row), pointer, path, code, message, meta, custom_message."""
    rows = each(frame.select(*keys, F.posexplode_outer(issues).alias("pos", "i")))
    return rows.select(*keys, "pos", pointer(F.col("i.path")).alias("pointer"), "i.path", "i.code", "i.message", "i.meta", "i.custom_message")


def _grouped(frame: DataFrame, keys: list[str], issues: str, what, name: str) -> DataFrame:
    held = F.col(issues)
    pointers = F.transform(held, lambda i: pointer(i["path"]))
    own = lambda p: F.transform(F.filter(held, lambda i: pointer(i["path"]) == p), what)
    one = lambda p: F.struct(p.alias("pointer"), (F.array_position(pointers, p) - 1).cast("int").alias("first"), own(p).alias(name))
    return frame.select(*keys, F.explode(F.transform(F.array_distinct(pointers), one)).alias("g")).select(*keys, "g.pointer", "g.first", f"g.{name}")


def flatten(frame: DataFrame, keys: list[str], issues: str = "issues") -> DataFrame:
    """Messages of each row by pointer, in order: keys, pointer, first (the place of the first), messages.

    Issues are grouped within their row, without a shuffle, so rows of equal keys stay apart.
    """
    return _grouped(frame, keys, issues, lambda i: i["message"], "messages")


def group_by_path(frame: DataFrame, keys: list[str], issues: str = "issues") -> DataFrame:
    """Like flatten, with the whole issues."""
    return _grouped(frame, keys, issues, lambda i: i, "issues")


def summary(frame: DataFrame, issues: str = "issues") -> DataFrame:
    """pointer, code and n over all rows; list indexes are part of the pointer."""
    rows = each(frame.select(F.explode_outer(issues).alias("i"))).select(pointer(F.col("i.path")).alias("pointer"), F.col("i.code").alias("code"))
    return rows.groupBy("pointer", "code").agg(F.count("*").alias("n"))


def flattened_column(issues: Column) -> Column:
    """Within a row: array of (pointer, messages) in order of first place."""
    points = F.array_distinct(F.transform(issues, lambda i: pointer(i["path"])))
    own = lambda p: F.transform(F.filter(issues, lambda i: pointer(i["path"]) == p), lambda i: i["message"])
    return F.transform(points, lambda p: F.struct(p.alias("pointer"), own(p).alias("messages")))


def _tree_builder():
    """The builder as a closure, which travels to the executors whole."""

    def build(paths, texts) -> dict:
        root: dict = {}
        for path, text in zip(paths, texts):
            node = root
            for segment in path:
                if not isinstance(node.get(segment), dict):
                    node[segment] = {}
                node = node[segment]
            if not isinstance(node.get("_errors"), list):
                node["_errors"] = []
            node["_errors"].append(text)
        return root

    return build


def error_tree(paths: list, texts: list) -> dict:
    """Nested dictionaries by segment, with the messages of a place under _errors."""
    return _tree_builder()(paths, texts)


def format_tree(issues: Column) -> Column:
    """The error tree of a row as JSON text. For reports: its shape is not one of columns."""
    build = _tree_builder()

    import pandas

    def trees(paths: pandas.Series, texts: pandas.Series) -> pandas.Series:
        import json

        return pandas.Series([None if p is None else json.dumps(build(p, t), ensure_ascii=False) for p, t in zip(paths, texts)])

    trees.__annotations__ = dict.fromkeys(("paths", "texts", "return"), pandas.Series)
    udf = F.pandas_udf(trees, "string")
    return udf(F.transform(issues, lambda i: i["path"]), F.transform(issues, lambda i: i["message"]))


def text_form(value: Column, issues: Column) -> Column:
    """Ok[value], or Err[path: message, ...] with / for the root."""
    one = lambda i: F.concat(F.when(F.size(i["path"]) == 0, F.lit("/")).otherwise(pointer(i["path"])), F.lit(": "), i["message"])
    return F.when(F.size(issues) == 0, F.concat(F.lit("Ok["), F.coalesce(value.cast("string"), F.lit("null")), F.lit("]"))).otherwise(F.concat(F.lit("Err["), F.array_join(F.transform(issues, one), ", "), F.lit("]")))
