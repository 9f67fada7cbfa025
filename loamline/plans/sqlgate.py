"""Read-only SQL over an archive's tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources.archive import table

# The plan nodes and functions that a reading statement may use.
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedInlineTable LocalRelation OneRowRelation "
    "UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction WithWindowDefinition Window Generate LateralJoin Pivot Unpivot ExplainCommand UnresolvedOrderBy Sample".split()
)
FUNCTIONS = frozenset(
    "abs array array_contains array_distinct array_join array_max array_min ascii avg base64 bool_and bool_or ceil ceiling char char_length chr coalesce collect_list collect_set concat concat_ws contains conv corr count count_if crc32 cume_dist "
    "current_date current_timestamp date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear decode dense_rank element_at encode endswith every exists exp explode explode_outer "
    "filter find_in_set first first_value flatten floor format_number format_string from_json from_unixtime from_utc_timestamp get get_json_object greatest hash hex hour if ifnull initcap instr isnan isnotnull isnull json_array_length json_object_keys json_tuple "
    "lag last last_day last_value lead least left len length levenshtein like listagg ln locate log log10 log2 lower lpad ltrim make_date map map_keys map_values max max_by md5 mean median min min_by minute mod month months_between nth_value ntile "
    "nullif nvl nvl2 octet_length percent_rank percentile percentile_approx pmod posexplode position pow power quarter range rank regexp regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace repeat replace reverse right round row_number "
    "rpad rtrim second sequence sha1 sha2 size slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string_agg struct substr substring substring_index sum timestamp timestamp_micros timestamp_millis to_date to_json to_timestamp "
    "to_unix_timestamp to_utc_timestamp transform trim trunc try_cast try_divide typeof unbase64 unhex unix_date unix_micros unix_timestamp upper var_pop var_samp variance weekday weekofyear when width_bucket xxhash64 year".split()
)
ROWS = 10_000


class ReadOnlyError(ValueError):
    """A statement that isn't one reading statement over the archive's tables."""


def _each(items) -> Iterator:
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def _refuse_expression(e, names: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        parts = [str(x) for x in _each(e.nameParts())]
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise ReadOnlyError(f"function {'.'.join(parts)} is not allowed")
    if hasattr(e, "plan") and any(i.getSimpleName() == "PlanExpression" for i in _bases(e.getClass())):
        _refuse(e.plan(), names)
    for child in _each(e.children()):
        _refuse_expression(child, names)


def _bases(cls) -> Iterator:
    while cls is not None:
        yield cls
        cls = cls.getSuperclass()


def _refuse(plan, names: set[str]) -> None:
    """Walk a parsed plan: every node, function and relation must be a known one."""
    kind = plan.getClass().getSimpleName()
    if kind not in NODES:
        raise ReadOnlyError(f"{kind} is not allowed in a reading statement")
    if kind == "ExplainCommand":
        _refuse(plan.logicalPlan(), names)
    if kind == "UnresolvedRelation":
        parts = [str(x) for x in _each(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0].lower() not in names:
            raise ReadOnlyError(f"{'.'.join(parts)} is no table of the archive")
    if kind == "UnresolvedTableValuedFunction":
        parts = [str(x) for x in _each(plan.name())]
        if [p.lower() for p in parts] not in (["range"], ["explode"], ["posexplode"]):
            raise ReadOnlyError(f"table function {'.'.join(parts)} is not allowed")
    if kind == "UnresolvedWith":
        relations = list(_each(plan.cteRelations()))
        names = names | {str(r._1()).lower() for r in relations}
        for r in relations:
            _refuse(r._2(), names)
    for e in _each(plan.expressions()):
        _refuse_expression(e, names)
    for child in _each(plan.children()):
        _refuse(child, names)


def guarded(spark: SparkSession, folder: str, statement: str, names: list[str], limit: int | None = None) -> DataFrame:
    """The rows of one reading statement over the named tables, all of them unless a limit is given; page() says whether there are more.

    Spark's own parser gives the plan; nodes, functions and relations that are not on the lists above are refused before anything runs.
    The tables are views of a session of its own, so none is left in the caller's.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement.strip().rstrip(";"))
    except Exception as e:
        raise ReadOnlyError(f"not one statement: {str(e).splitlines()[0]}") from e
    _refuse(plan, {n.lower() for n in names})
    own = spark.newSession()
    own.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # a recursion's rows are all returned; its depth stays bound by cteRecursionLevelLimit
    for name in names:
        table(own, folder, name).createOrReplaceTempView(name)
    df = own.sql(statement.strip().rstrip(";"))
    return df.limit(limit) if limit is not None else df


def page(spark: SparkSession, folder: str, statement: str, names: list[str], limit: int = ROWS) -> tuple[DataFrame, bool]:
    """At most `limit` rows of a statement, in its order, and whether there are more."""
    rows = guarded(spark, folder, statement, names).limit(limit + 1)
    first = spark.createDataFrame(rows.toArrow()) if limit <= ROWS else rows  # read once, at most ROWS + 1 rows
    return first.limit(limit), first.count() > limit
