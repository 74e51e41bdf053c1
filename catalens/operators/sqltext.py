r"""Pattern mining over a table of SQL texts.

Works on a defined subset of SQL with regular expressions: every pattern is a projection of one row, so a
table of texts is mined in one scan without a shuffle. Comments are removed, blanks collapsed, and the
content of string literals is hex-encoded first, so that words inside literals are never taken for SQL.

Expressions may nest to any depth. One scan over the brackets and the CASE, BEGIN and END of a text gives each its
depth (``tagged``); a bracket closes at the next one of its own depth, which a back reference finds. Patterns are
looked for at every place, also inside others: an aggregate in another's argument, a CASE inside a CASE, a division
inside a bracket. A division takes what is multiplied or divided to its left and one operand to its right.

Subset: a join's left side is the table after the nearest preceding FROM (``UNKNOWN`` for a derived table), tables
after a comma are inner joins without columns; an alias may come without AS and may follow OVER (...), and belongs to
a division or CASE that begins its select item, or to an aggregate right before it. ``columns_referenced`` gives qualified
names (``t.column``); unqualified ones need a catalog (``resolved_columns``).
A null text has no pattern. A bracket that never closes is no argument.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- patterns ---------------------------------------------------------------------------------------

# possessive repeats (*+) keep a failed match from being retried inside a word
IDENT = r'(?:\[[^\]]+\]|"[^"]+"|(?:\b[A-Za-z_]|#)[A-Za-z0-9_#$]*+)'
NAME = rf"{IDENT}(?:\.{IDENT})*+"
LITERAL = r"(?:'[0-9A-F]*')+"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
VALUE = rf"{LITERAL}|@[A-Za-z0-9_]+|\?|{NUMBER}|\(\s*SELECT\b|{NAME}(?:\([^()]*\))?"

COMMENT = r"(?s)('[^']*')|--[^\n]*|/\*.*?\*/"
BLANKS = r"\s{2,}|[\t\n\x0B\f\r]"  # all runs of blanks but a single space
FROM_SPLIT = r"(?i)\bFROM\s+"
JOIN_MARK = r"(?i)\b(?:(INNER|CROSS|LEFT|RIGHT|FULL)\s+)?(?:OUTER\s+)?JOIN\s+"
ON_PART = r"(?i)\bON\s+(.*)"
ON_END = r"(?i)\b(?:WHERE|GROUP\s+BY|ORDER\s+BY|HAVING|UNION)\b|;"
ON_PAIR = rf"({NAME})\s*=\s*({NAME})"
ALIAS = rf"(?:\s+(?:AS\s+)?({IDENT}))?"  # may be a word of NO_ALIAS
WHERE_SPLIT = r"(?i)\bWHERE\b"
WHERE_END = r"(?i)\b(?:GROUP\s+BY|ORDER\s+BY|HAVING|UNION)\b|;"
CONDITION = (
    rf"(?i)(?:\b(NOT)\s+)?({NAME})\s*(?:"
    rf"(>=|<=|!=|<>|=|>|<)\s*({VALUE})"
    rf"|\s(?:(NOT)\s+)?LIKE\s+({VALUE})"
    rf"|\s(?:(NOT)\s+)?IN\s*(\(\s*SELECT\b|\([^()]*\))"
    rf"|\s(?:(NOT)\s+)?BETWEEN\s+({VALUE})\s+AND\s+({VALUE})"
    rf"|\sIS\s+(?:(NOT)\s+)?NULL\b)"
)
HAS_AGGREGATE = r"(?i)\b(?:SUM|COUNT|AVG)\s*\("
WORD_OR_CALL = rf"{NAME}\s*\(?"
TABLE_REF = rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+({NAME})"
QUALIFIED = rf"{IDENT}\.{IDENT}(?:\.{IDENT})*"
# brackets and CASE ... END carry their depth between these two characters; a third marks where select items begin
OPEN, SHUT, ITEM = "\x02", "\x03", "\x04"
BRACKET = r"(?i)[()]|\b(?:CASE|END)\b|\bBEGIN\b(?!\s+TRAN)"
TAG = rf"{OPEN}-?[0-9]+{SHUT}|{ITEM}"
ITEM_START = r"(?i)(\bSELECT\s(?:(?:DISTINCT|ALL)\s|TOP\s*(?:[0-9]+|\(\x02-?[0-9]+\x03[^()]*\)\x02-?[0-9]+\x03)\s)*|,\s?)"
LISTED = rf"{NAME}(?:\s+(?:AS\s+)?(?!(?:INNER|CROSS|LEFT|RIGHT|FULL|OUTER|JOIN)\b){IDENT})?"
FROM_LIST = rf"(?i)^{LISTED}(?:\s*,\s*{LISTED})+"


def nested(group: int, opens: str = r"\(", shuts: str = r"\)") -> str:
    """From a bracket to its partner, never further; uses ``group`` for the depth and the next group for what is inside."""
    return rf"{opens}{OPEN}(-?[0-9]+){SHUT}(?>(.*?){shuts}{OPEN}\{group}{SHUT})"


def behind(group: int) -> str:
    """What may stand between an aggregate and its alias."""
    return rf"(?:\s*(?:OVER|FILTER|WITHIN GROUP)\s*{nested(group)}|\s+OVER\s+{IDENT})*+"


# fixed values: words that no operand begins with
NO_OPERAND = (
    "SELECT|DISTINCT|ALL|TOP|WHEN|THEN|ELSE|END|AND|OR|NOT|WHERE|ON|BY|HAVING|IN|BETWEEN|LIKE|SET|RETURN|FROM|CASE|AS|IF|"
    "WHILE|PRINT|VALUES|UNION|EXCEPT|INTERSECT|LIMIT|OFFSET|INTO|IS|EXISTS|BEGIN|JOIN|OVER"
)
# fixed values: a text without them has no such pattern (characters of the tags count as blanks)
AGGREGATES = r"(?i)\b(?:SUM|COUNT|AVG|MIN|MAX)[\s\x01-\x04]*\("
JOINS = r"(?i),|\x01|\bJOIN\b"
AGGREGATE_AT = r"(?:SUM|COUNT|AVG|MIN|MAX)\s*\("


def operand(group: int) -> str:
    """One operand; uses four groups, or six with what stands behind a call."""
    call = rf"(?!(?:{NO_OPERAND})\b)(?:{NAME}\s*)?{nested(group)}{behind(group + 2)}"
    case = nested(group + 4, r"\bCASE", r"\bEND")
    return rf"(?:{call}|{case}|(?!(?:{NO_OPERAND})\b){NAME}|@[A-Za-z0-9_]+|[0-9]+(?:\.[0-9]*)?|{LITERAL})"


AGGREGATE = rf"(?is)({ITEM}?)\b(SUM|COUNT|AVG|MIN|MAX)\s*{nested(3)}{behind(5)}{ALIAS}"
FACTOR = rf"(?is)\s*([*/%]?)\s*-?{operand(2)}"
DIVISION = rf"(?is)({ITEM}?)({operand(3)}(?:\s*[*/%]\s*-?{operand(9)})+){ALIAS}"
CASE = rf"(?is)({ITEM}?)\b({nested(3, 'CASE', 'END')}){ALIAS}"
#: Where a match may begin: not inside a name or number, nor behind a mark or an operator that binds as tightly.
FREE = rf"(?<![A-Za-z0-9_.$#@\]{ITEM}])"
CALLED = rf"(?:(?!\()|(?<=\b(?:{NO_OPERAND.removesuffix('|OVER')})\s)|(?<![A-Za-z0-9_\]\"]\s))"  # no bracket of a call
FREE_AGGREGATE = rf"(?=[{ITEM}SCAM]){FREE}"  # what else no match begins with is passed over at once
FREE_CASE = rf"(?=[{ITEM}C]){FREE}"
FREE_FACTOR = rf"{FREE}(?<![*/%\"'])(?<![*/%]\s){CALLED}"
# fixed values: words after an expression that are no alias
NO_ALIAS = [
    "AND", "AS", "ASC", "BEGIN", "BETWEEN", "COLLATE", "CROSS", "DECLARE", "DELETE", "DESC", "ELSE", "END", "EXCEPT", "EXEC",
    "FETCH", "FILTER", "FOR", "FROM", "FULL", "GROUP", "HAVING", "IF", "IN", "INNER", "INSERT", "INTERSECT", "INTO", "IS",
    "JOIN", "LEFT", "LIKE", "LIMIT", "NOT", "OFFSET", "ON", "OPTION", "OR", "ORDER", "OVER", "RETURN", "RIGHT", "SELECT",
    "SET", "THEN", "UNION", "UPDATE", "WHEN", "WHERE", "WITH", "WITHIN",
]
LISTED_SOURCE = rf"{NAME}(?:\s+(?:AS\s+)?(?!(?:{'|'.join(NO_ALIAS)})\b){IDENT})?"
SOURCES = rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+({LISTED_SOURCE}(?:\s*,\s*{LISTED_SOURCE})*)"
# names that stand alone: no part of a longer name, no parameter; calls end with a bracket
SINGLE = rf"(?<![A-Za-z0-9_.@#$\]\"]){NAME}\s*\(?"
# fixed values: words of a formula that are not columns
FORMULA_WORDS = [
    "CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "BETWEEN", "AS",
    "DISTINCT", "FLOAT", "INT", "DECIMAL",
]
SQL_WORDS = sorted({*NO_ALIAS, *FORMULA_WORDS, *NO_OPERAND.split("|"), "GO", "OUTER", "PARTITION", "PERCENT", "ROWS", "TIES", "TRAN", "PROCEDURE", "PROC", "VIEW", "CREATE", "ALTER", "FUNCTION", "TABLE", "NOCOUNT", "OFF"})


# --- text preparation -------------------------------------------------------------------------------


def masked(definition: str | Column = "definition") -> Column:
    """Text without comments, blanks collapsed, contents of string literals hex-encoded."""
    text = F.coalesce(F.col(definition) if isinstance(definition, str) else definition, F.lit(""))
    # most texts have no comment, and many no literal: what would leave them as they are is not run
    commented = F.contains(text, F.lit("--")) | F.contains(text, F.lit("/*"))
    clean = F.when(commented, F.regexp_replace(text, COMMENT, "$1")).otherwise(text)
    parts = F.split(clean, "'")
    coded = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.hex(p)).otherwise(p))
    coded = F.when(F.contains(text, F.lit("'")), F.array_join(coded, "'")).otherwise(clean)
    return F.trim(F.regexp_replace(coded, BLANKS, " "))


def prepare(objects: DataFrame, definition: str = "definition") -> DataFrame:
    """Adds ``sql``, the masked text that the extraction columns read.

    Mining is CPU-bound: a text table in fewer files than there are cores is worth a ``repartition`` first;
    a large one has enough splits of its own.
    """
    return objects.withColumn("sql", masked(definition))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column) -> Column:
    """Running sums of a short array."""
    empty = F.array().cast("array<int>")
    return F.aggregate(
        values, empty, lambda a, x: F.concat(a, F.array(x + F.when(F.size(a) > 0, F.get(a, F.size(a) - 1)).otherwise(0)))
    )


def _depths(steps: Column) -> Column:
    """Running sums of an array, in blocks of its square root: sums within each block, and over the blocks before it."""
    width = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))
    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), width)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda at: _running(F.slice(steps, at, width)))

    def joined(b: Column) -> Column:
        ends = _running(F.concat(F.array(F.lit(0)), F.transform(b, lambda x: F.element_at(x, -1))))
        pairs = F.filter(F.arrays_zip(b.alias("b"), ends.alias("e")), lambda z: z["b"].isNotNull())
        return F.flatten(F.transform(pairs, lambda z: F.transform(z["b"], lambda x: x + z["e"])))

    return _let(blocks, joined)


def tagged(sql: str = "sql") -> Column:
    """The masked text with the depth behind each bracket, CASE, BEGIN and END; partners have the same one."""
    text = F.regexp_replace(F.col(sql), "[\x01-\x04]", " ")
    pieces = F.split(F.regexp_replace(text, BRACKET, "\x01$0\x01"), "\x01")

    def tags(marks: Column, opens: list[str], shuts: list[str]) -> Column:
        steps = F.transform(marks, lambda m: F.when(m.isin(opens), 1).when(m.isin(shuts), -1).otherwise(0))
        return _let(steps, lambda s: F.zip_with(_depths(s), s, lambda d, step: d + F.when(step < 0, 1).otherwise(0)))

    def of_pieces(p: Column) -> Column:
        marks = F.transform(F.filter(p, lambda _, i: i % 2 == 1), F.upper)

        def of_marks(m: Column) -> Column:
            both = F.zip_with(
                tags(m, ["("], [")"]), tags(m, ["CASE", "BEGIN"], ["END"]), lambda d, level: F.struct(d.alias("d"), level.alias("level"))
            )
            tag = F.zip_with(m, both, lambda x, z: F.concat(
                F.lit(OPEN), F.when(x.isin("(", ")"), z["d"]).otherwise(z["level"]).cast("string"), F.lit(SHUT)))
            plain = F.filter(p, lambda _, i: i % 2 == 0)
            marked = F.zip_with(F.filter(p, lambda _, i: i % 2 == 1), tag, lambda x, y: F.concat(x, y))
            return F.array_join(F.zip_with(plain, marked, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")

        return _let(marks, of_marks)

    return F.regexp_replace(_let(pieces, of_pieces), ITEM_START, f"$1{ITEM}")


def _plain(text: Column) -> Column:
    """Text without tags."""
    return F.regexp_replace(text, TAG, "")


def _everywhere(text: Column, pattern: str, groups: int, free: str = FREE) -> Column:
    """As ``_matches``, for matches at every place, also inside one another."""
    flags, body = _flags(pattern)
    joined = "\x01".join(f"${i}" for i in range(1, groups + 1))
    return F.transform(_places(text, pattern, free), lambda m: F.split(F.regexp_replace(m, f"{flags}^{body}$", joined), "\x01"))


def _flags(pattern: str) -> tuple[str, str]:
    """A pattern's flags and what stands behind them."""
    at = pattern.index(")") + 1
    return pattern[:at], pattern[at:]


def _places(text: Column, pattern: str, free: str = FREE) -> Column:
    """The matches at every place, also inside one another."""
    flags, body = _flags(pattern)
    # the match is looked for ahead of a place, as group 1; its own groups come one later there
    return _all(text, f"{flags}{free}(?=({_shift(body)}))", 1)


def _shift(pattern: str) -> str:
    """A pattern whose back references count one more group."""
    return re.sub(r"\\([0-9]+)", lambda m: f"\\{int(m.group(1)) + 1}", pattern)


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(name, r'[\[\]"]', "")


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _alias(name: Column) -> Column:
    """The alias in the text after an expression, null for none; a quoted word is always one."""
    return F.when(~F.upper(name).isin(NO_ALIAS), _or_null(_unquoted(name)))


def _literal_text(value: Column) -> Column:
    """Text of a masked literal; a doubled quote inside it comes back as one quote."""
    parts = F.split(value, "'")
    inner = F.filter(parts, lambda p, i: i % 2 == 1)
    return F.array_join(F.transform(inner, lambda p: F.unhex(p).cast("string")), "'")


def value_pattern(value: Column) -> Column:
    """Description of a compared value: literal text, parameter, ``(subquery)`` or expression, cut at 50."""
    value = F.trim(value)
    return (
        F.when(value.startswith("'"), F.substring(_literal_text(value), 1, 50))
        .when(value.startswith("("), "(subquery)")
        .when(F.upper(value) == "NULL", "NULL")
        .otherwise(F.substring(value, 1, 50))
    )


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _matches(text: Column, pattern: str, groups: int) -> Column:
    """Every match as the array of its groups (1 …), each match run through the regex once more, not once per group."""
    joined = "\x01".join(f"${i}" for i in range(1, groups + 1))
    return F.transform(_all(text, pattern), lambda m: F.split(F.regexp_replace(m, pattern, joined), "\x01"))


def _tail(parts: Column) -> Column:
    """Array without its first element."""
    return F.filter(parts, lambda _, i: i > 0)


def _join_pieces(segment: Column) -> Column:
    """The kind and right side of every JOIN, or comma, behind one FROM."""
    listed = F.regexp_extract(segment, FROM_LIST, 0)
    rest = F.substr(segment, F.length(listed) + 1)
    marked = F.concat(F.regexp_replace(listed, ",", "\x01\x02"), F.regexp_replace(rest, JOIN_MARK, "\x01$1\x02"))
    return _tail(F.split(marked, "\x01"))


def _joined(piece: Column) -> Column:
    """The right side in a piece of ``_join_pieces``."""
    return F.ltrim(F.substring_index(piece, "\x02", -1))


def _clauses(sql: str) -> Column:
    """The conditions behind every WHERE."""
    return F.transform(_tail(F.split(F.col(sql), WHERE_SPLIT)), lambda c: F.get(F.split(c, WHERE_END, 2), 0))


# --- one array column per kind of pattern -----------------------------------------------------------


def joins(sql: str = "sql") -> Column:
    """``left_table, right_table, join_type, on_columns`` of every JOIN."""

    def of_from(segment: Column) -> Column:
        start = _or_null(F.regexp_extract(segment, rf"^({NAME})", 1))
        left = F.coalesce(_unquoted(start), F.lit("UNKNOWN"))

        def of_join(piece: Column) -> Column:
            kind, rest = F.substring_index(piece, "\x02", 1), _joined(piece)
            on = F.get(F.split(F.regexp_extract(rest, ON_PART, 1), ON_END, 2), 0)
            pairs = F.transform(
                _matches(on, ON_PAIR, 2),
                lambda g: F.struct(_unquoted(g[0]).alias("left_column"), _unquoted(g[1]).alias("right_column")),
            )
            return F.struct(
                left.alias("left_table"),
                _unquoted(F.regexp_extract(rest, rf"^({NAME})", 1)).alias("right_table"),
                F.coalesce(F.upper(_or_null(kind)), F.lit("INNER")).alias("join_type"),
                pairs.alias("on_columns"),
            )

        return F.transform(_join_pieces(segment), of_join)

    found = F.flatten(F.transform(_tail(F.split(F.col(sql), FROM_SPLIT)), of_from))
    return F.filter(found, lambda j: j["right_table"] != "")


def aggregations(sql: str = "sql") -> Column:
    """``function, column, alias, context`` of every SUM, COUNT, AVG, MIN and MAX."""

    def one(g: Column) -> Column:
        column = F.regexp_replace(F.trim(_plain(g[3])), r"(?i)^DISTINCT\s+", "")
        plain = column.rlike(rf"^{NAME}$")
        prefix = F.regexp_extract(column, rf"^({IDENT})\.", 1)
        return F.struct(
            F.upper(g[1]).alias("function"),
            F.when(column == "", "*").when(plain, _unquoted(column)).otherwise(column).alias("column"),
            _alias(g[6]).alias("alias"),
            F.when(plain, _or_null(_unquoted(prefix))).alias("context"),
        )

    return F.transform(_everywhere(tagged(sql), AGGREGATE, 7, FREE_AGGREGATE), one)


def filters(sql: str = "sql") -> Column:
    """``column, operator, value_pattern`` of every WHERE condition, NOT forms included."""

    def one(g: Column) -> Column:
        def part(i: int) -> Column:
            return g[i - 1]

        compare, like, in_list, low = part(3), part(6), part(8), part(10)
        negated = F.concat_ws("", part(1), part(5), part(7), part(9), part(12)) != ""
        listed = F.substring(in_list, F.lit(2), F.length(in_list) - 2)
        in_values = F.transform(F.split(listed, ","), value_pattern)
        shown = F.concat_ws(
            ", ", F.slice(in_values, 1, 5), F.when(F.size(in_values) > 5, F.array(F.lit("..."))).otherwise(
                F.array().cast("array<string>")
            ),
        )
        is_in = in_list != ""
        operator = (
            F.when(compare == "<>", "!=").when(compare != "", compare).when(like != "", "LIKE")
            .when(is_in, "IN").when(low != "", "BETWEEN").otherwise("IS NULL")
        )
        value = (
            F.when(compare != "", value_pattern(part(4)))
            .when(like != "", value_pattern(like))
            .when(is_in & in_list.rlike(r"(?i)^\(\s*SELECT\b"), "(subquery)")
            .when(is_in, F.concat(F.lit("("), shown, F.lit(")")))
            .when(low != "", F.concat(value_pattern(low), F.lit(" AND "), value_pattern(part(11))))
            .otherwise("NULL")
        )
        negative = F.when(operator == "IS NULL", "IS NOT NULL").otherwise(F.concat(F.lit("NOT "), operator))
        return F.struct(
            _unquoted(part(2)).alias("column"),
            F.when(negated, negative).otherwise(operator).alias("operator"),
            value.alias("value_pattern"),
        )

    return F.transform(F.flatten(F.transform(_clauses(sql), lambda c: _matches(c, CONDITION, 12))), one)


def formula_columns(formula: Column) -> Column:
    """Names in a formula that are neither calls nor SQL words, in order, repeats kept."""
    words = F.filter(_all(formula, WORD_OR_CALL), lambda w: ~w.endswith("("))
    names = F.transform(words, lambda w: _unquoted(F.trim(w)))
    return F.filter(names, lambda w: ~F.upper(w).isin(FORMULA_WORDS))


def _unmasked(text: Column) -> Column:
    """Literal contents decoded again, for display."""
    parts = F.split(text, "'")
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.unhex(p).cast("string")).otherwise(p)), "'"
    )


def _metric(name: Column, formula: Column, ratio: bool) -> Column:
    formula = F.trim(_plain(formula))
    return F.struct(
        name.alias("name"),
        F.substring(_unmasked(formula), 1, 500).alias("formula"),
        formula_columns(F.regexp_replace(formula, LITERAL, "''")).alias("columns_used"),
        F.lit(ratio).alias("is_ratio"),
    )


def ratio_metrics(sql: str = "sql") -> Column:
    """``name, formula, columns_used, is_ratio`` of every division."""

    def of_chain(g: Column) -> Column:
        factors = _all(g[1], FACTOR)
        last = F.size(factors) - 1
        places = F.filter(F.sequence(F.lit(0), last), lambda i: F.trim(F.get(factors, i)).startswith("/"))
        whole = F.when(g[0] != "", _alias(g[14]))
        return F.transform(
            places, lambda i: _metric(F.when(i == last, whole), F.array_join(F.slice(factors, F.lit(1), i + 1), ""), True)
        )

    text = F.when(F.contains(F.col(sql), F.lit("/")), tagged(sql)).otherwise("")
    return F.flatten(F.transform(_everywhere(text, DIVISION, 15, FREE_FACTOR), of_chain))


def case_metrics(sql: str = "sql") -> Column:
    """The same fields for every CASE expression that contains SUM, COUNT or AVG."""
    found = F.filter(_everywhere(tagged(sql), CASE, 5, FREE_CASE), lambda g: g[1].rlike(HAS_AGGREGATE))
    return F.transform(found, lambda g: _metric(F.when(g[0] != "", _alias(g[4])), g[1], False))


def metrics(sql: str = "sql") -> Column:
    return F.concat(ratio_metrics(sql), case_metrics(sql))


def tables_referenced(sql: str = "sql") -> Column:
    names = F.transform(_all(F.col(sql), TABLE_REF, 1), _unquoted)
    return F.sort_array(F.array_distinct(names))


def columns_referenced(sql: str = "sql") -> Column:
    """Distinct qualified names that are not tables."""
    names = F.array_distinct(F.transform(_all(F.col(sql), QUALIFIED), _unquoted))
    return F.sort_array(F.array_except(names, tables_referenced(sql)))


def source_tables(sql: str = "sql") -> Column:
    """Distinct names of the tables after FROM, JOIN, INTO and UPDATE, those behind a comma too."""
    lists = _all(F.col(sql), SOURCES, 1)
    each = F.flatten(F.transform(lists, lambda s: _all(s, f"(?i){LISTED_SOURCE}")))
    return F.array_distinct(F.transform(each, lambda s: _unquoted(F.regexp_extract(s, rf"^({NAME})", 1))))


def single_names(sql: str = "sql") -> Column:
    """Distinct names without a qualifier that may be columns, as written.

    Tables and their aliases, words after AS or right behind a bracket, calls, parameters, literals and SQL's own words
    are none; a quoted word may be.
    """
    rest = F.regexp_replace(F.col(sql), SOURCES, " ; ")
    rest = F.regexp_replace(F.regexp_replace(rest, LITERAL, "''"), rf"(?i)\bAS\s+{IDENT}", " ")
    rest = F.regexp_replace(rest, rf"(?i)\)\s+(?!(?:{'|'.join(NO_ALIAS)})\b){IDENT}", ")")
    words = F.transform(_all(rest, SINGLE), lambda w: F.trim(w))
    names = F.filter(words, lambda w: w.rlike(f"^{IDENT}$") & ~w.startswith("#") & ~F.upper(w).isin(SQL_WORDS))
    return F.array_distinct(F.transform(names, _unquoted))


def resolved_columns(prepared: DataFrame, columns: DataFrame, keep: list[str], database: str = "database") -> DataFrame:
    """The unqualified names of each text and the table whose column each one is.

    ``columns`` holds ``database, schema, table_name, column_name``. A name is looked for in the text's own tables, in the
    database they name or else the text's, without regard to case. ``state`` is ``resolved`` for one table,
    ``ambiguous`` for several (then no table is given) and ``unknown`` for none: an alias, or a column the catalog lacks.
    Texts with equal ``keep`` count as one. One row per text and name.

    (table, name) pairs of a text meet the catalog by equality, and the catalog has each column once, so the join gives
    no more rows than it reads and a table that many texts use can be split.
    """
    names = prepared.select(
        *keep, F.col(database).alias("_text_database"), source_tables().alias("_tables"), F.explode(single_names()).alias("name")
    )
    parts = F.split("_table", r"\.")

    def part(i: int) -> Column:  # from the right
        return F.lower(F.nullif(F.try_element_at(parts, F.lit(-i)), F.lit("")))

    wanted = names.select("*", F.explode_outer("_tables").alias("_table")).select(
        *keep, "name", F.coalesce(part(3), F.lower("_text_database")).alias("_d"), part(2).alias("_s"), part(1).alias("_t"),
        F.lower("name").alias("_c"),
    )
    known = columns.groupBy(
        F.lower("database").alias("_d"), F.lower("schema").alias("_ks"), F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c")
    ).agg(F.min(F.struct("database", "schema", "table_name")).alias("_home"))
    met = wanted.join(known, ["_d", "_t", "_c"], "left")
    home = F.when(F.col("_s").isNull() | F.col("_s").eqNullSafe(F.col("_ks")), F.col("_home"))
    ends = met.groupBy(*keep, "name").agg(F.min(home).alias("_low"), F.max(home).alias("_high"))
    one = F.col("_low").eqNullSafe(F.col("_high"))
    return ends.select(
        *keep, "name",
        F.when(F.col("_low").isNull(), "unknown").when(one, "resolved").otherwise("ambiguous").alias("state"),
        F.when(one, F.col("_low.database")).alias("table_database"),
        F.when(one & F.col("_low").isNotNull(), F.concat_ws(".", "_low.schema", "_low.table_name")).alias("table"),
    )


KINDS = {"joins": joins, "aggregations": aggregations, "filters": filters, "metrics": metrics}


def with_patterns(prepared: DataFrame) -> DataFrame:
    """All pattern arrays side by side."""
    return prepared.withColumns(
        {**{name: make() for name, make in KINDS.items()}, "tables": tables_referenced(),
         "columns": columns_referenced()}
    )


def exploded(prepared: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """One row per pattern of ``kind`` with its ``position`` in the text."""
    return unnested(prepared.select(*keep, mined(kind).alias("_found")), "_found")


def mined(kind: str) -> Column:
    """Array of the patterns of one kind."""
    return {**KINDS, "ratio_metrics": ratio_metrics, "case_metrics": case_metrics}[kind]()


def unnested(df: DataFrame, patterns: str) -> DataFrame:
    """One row per entry of a pattern array, its fields as columns next to the others.

    The outer form with a filter behind it: for a plain explode Spark infers a filter on the array's size and
    pushes it to the scan, which would mine every text twice.
    """
    keep = [c for c in df.columns if c != patterns]
    return (
        df.select(*keep, F.posexplode_outer(patterns).alias("position", "_p"))
        .where(F.col("position").isNotNull())
        .select(*keep, "position", "_p.*")
    )


def counted(prepared: DataFrame, keep: list[str]) -> DataFrame:
    """Numbers of patterns of each kind per text, as many as the arrays of ``KINDS`` have entries.

    Brackets are tagged once a text for all kinds, and only where one of them may be; no field of a pattern is made.
    """
    sql = F.col("sql")

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0), lambda a, x: a + x)

    def of_from(segment: Column) -> Column:
        names = F.transform(_join_pieces(segment), lambda x: _unquoted(F.regexp_extract(_joined(x), rf"^({NAME})", 1)))
        return F.when(segment.rlike(JOINS), F.size(F.filter(names, lambda x: x != ""))).otherwise(0)

    def of_chain(match: Column) -> Column:
        flags, body = _flags(DIVISION)
        factors = _all(F.regexp_replace(match, f"{flags}^{body}$", "$2"), FACTOR)
        return F.size(F.filter(factors, lambda x: F.trim(x).startswith("/")))

    def of_case(match: Column) -> Column:
        flags, body = _flags(CASE)
        return match.rlike(HAS_AGGREGATE) & F.regexp_replace(match, f"{flags}^{body}$", "$2").rlike(HAS_AGGREGATE)

    def where(has: str) -> Column:
        return F.when(F.col(has), F.col("_tagged")).otherwise("")

    has = {"_aggregates": sql.rlike(AGGREGATES), "_divisions": F.contains(sql, F.lit("/")), "_cases": sql.rlike(r"(?i)\bCASE\b")}
    rows = prepared.withColumns(has)
    rows = rows.withColumn("_tagged", F.when(reduce(Column.__or__, map(F.col, has)), tagged()).otherwise(""))
    return rows.select(
        *keep, "sql",
        total(F.transform(_tail(F.split(sql, FROM_SPLIT)), of_from)).alias("joins"),
        F.size(_places(where("_aggregates"), AGGREGATE, FREE_AGGREGATE)).alias("aggregations"),
        total(F.transform(_clauses("sql"), lambda c: F.size(_all(c, CONDITION)))).alias("filters"),
        (
            total(F.transform(_places(where("_divisions"), DIVISION, FREE_FACTOR), of_chain))
            + F.size(F.filter(_places(where("_cases"), CASE, FREE_CASE), of_case))
        ).alias("metrics"),
    )


def complexity(prepared: DataFrame, keep: list[str]) -> DataFrame:
    """Numbers of tables, joins, aggregations, filters and metrics per text."""
    tables = F.array_distinct(F.transform(_all(F.col("sql"), TABLE_REF, 1), _unquoted))
    return counted(prepared, keep).select(*keep, F.size(tables).alias("tables"), *KINDS)


def parse_errors(objects: DataFrame, keep: list[str], definition: str = "definition") -> DataFrame:
    """Texts that cannot be mined, with the reason; they never stop the job."""
    text = F.regexp_replace(F.coalesce(F.col(definition), F.lit("")), COMMENT, "$1")
    quotes = F.length(text) - F.length(F.replace(text, F.lit("'"), F.lit("")))
    reason = F.when(F.trim(text) == "", "Empty SQL").when(quotes % 2 == 1, "Unbalanced quotes")
    return objects.select(*keep, reason.alias("error")).where("error is not null")


# --- totals over all texts --------------------------------------------------------------------------


def _top(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), key).limit(n)


def top_joined_tables(joined: DataFrame, n: int = 20) -> DataFrame:
    """Most joined tables, both sides counted, unknown left sides not."""
    sides = joined.select(F.explode(F.array("left_table", "right_table")).alias("table"))
    return _top(sides.where(F.col("table") != "UNKNOWN"), "table", n)


def top_aggregated_columns(found: DataFrame, n: int = 20) -> DataFrame:
    return _top(found.where(F.col("column") != "*"), "column", n)


def top_filtered_columns(found: DataFrame, n: int = 20) -> DataFrame:
    """Most filtered columns, table prefix dropped."""
    return _top(found.select(F.substring_index("column", ".", -1).alias("column")), "column", n)


def top_filter_patterns(found: DataFrame, n: int = 20) -> DataFrame:
    return _top(found.select(F.concat_ws(" ", "column", "operator").alias("pattern")), "pattern", n)


def pattern_totals(prepared: DataFrame) -> DataFrame:
    """Patterns of each kind over all texts."""
    return counted(prepared, []).agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in KINDS])


def first_metrics(prepared: DataFrame, keep: list[str], n: int = 50) -> DataFrame:
    """The first ``n`` metrics in object order."""
    return exploded(prepared, "metrics", keep).orderBy(*keep, "position").limit(n)
