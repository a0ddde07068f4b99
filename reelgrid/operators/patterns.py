"""Many regular expressions on many texts, by the literals that each expression requires.

A match of `(large|small) ring.*\\d` holds "large ring" or "small ring"; a match of `web.?rip` holds "web" and "rip", of
which the longest part is kept. One Aho-Corasick automaton per group of patterns (a tenant's) reads a text once and names
the patterns with a literal in it; only these pairs are judged. Patterns without such a literal, or that Python's parser does not
read as Java's does, meet all texts of their group.

The automata go to the tasks as a broadcast if the literals are few (MOST_BYTES); beyond, texts and literals meet in a join on a
literal's rarest trigram. Both name the same pairs.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

LEAST_LITERAL, MOST_BYTES = 3, 32 << 20
#: Rules of one pattern that a row carries at most.
MOST_LISTED = 1024
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
#: Escapes that both parsers read alike; patterns with others, or with inline flags, are not taken apart.
COMMON_ESCAPES = re.compile(r"\\[^wWdDsSbB.\\/+*?()\[\]{}|^$ _-]")


def worth(literals: list[str] | None) -> int:
    return min(map(len, literals)) if literals else 0


def of_sequence(items) -> list[str] | None:
    """The literals of which any match of a parsed sequence holds at least one."""
    best, run = None, ""
    for op, value in [*items, (None, None)]:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        if len(run) > worth(best):
            best = [run]
        run, found = "", None
        if op is sre.SUBPATTERN and not value[1] and not value[2]:
            found = of_sequence(value[3])
        elif op is sre.BRANCH:
            each = [of_sequence(x) for x in value[1]]
            found = [x for xs in each for x in xs] if all(each) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
            found = of_sequence(value[2])
        elif op is sre.ATOMIC_GROUP:
            found = of_sequence(value)
        if worth(found) > worth(best):
            best = found
    return best


def required(pattern: str | None) -> list[str] | None:
    """Lower-case literals (A-Z) of which a match holds one; None if no such list of useful length is known."""
    if not pattern or COMMON_ESCAPES.search(pattern) or "(?" in pattern.replace("(?:", ""):
        return None
    try:
        found = of_sequence(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None
    return sorted({x.translate(ASCII_LOWER) for x in found}) if worth(found) >= LEAST_LITERAL else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def required_literals(pattern):
    return pattern.map(required)


def hits(texts: DataFrame, literals: DataFrame, group: str, text: str, rule: str, columns: list[str]) -> DataFrame:
    """columns of texts and the rule, for texts(group, text, ...) that hold a literal of literals(group, rule, literal) of their group."""
    size = literals.agg(F.sum(F.length("literal") + 64)).first()[0] or 0
    if size <= MOST_BYTES:
        of: dict = {}
        for r in literals.select(group, rule, "literal").collect():  # MOST_BYTES at most
            of.setdefault(r[0], {}).setdefault(r[2], []).append(r[1])
        return by_automata(texts, of, group, text, literals.schema[rule].dataType.simpleString(), rule, columns)
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    often = literals.select(group, F.explode(grams(F.col("literal"))).alias("gram")).groupBy(group, "gram").agg(F.count("*").alias("n"))
    each = literals.select(group, rule, "literal", F.explode(grams(F.col("literal"))).alias("gram")).join(often, [group, "gram"])
    rarest = each.groupBy(group, rule, "literal").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    probe = texts.withColumn("_low", low).withColumn("gram", F.explode(grams(F.col("_low"))))
    return probe.join(rarest, [group, "gram"]).where(F.contains("_low", F.col("literal"))).select(*columns, rule).distinct()


def by_automata(texts: DataFrame, of: dict, group: str, text: str, kind: str, rule: str, columns: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(of)
    rows = texts.select(*columns, F.col(group).alias("_group"), F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField(rule, T.DataType.fromDDL(kind))])
    arrow = to_arrow_type(schema[rule].dataType)

    def run(batches):
        import ahocorasick

        automata: dict = {}

        def automaton(g):
            if g not in automata:
                made = ahocorasick.Automaton()
                for literal, rules in shared.value.get(g, {}).items():
                    made.add_word(literal, rules)
                made.make_automaton()
                automata[g] = made
            return automata[g]

        for b in batches:
            row, found = [], []
            for i, (g, t) in enumerate(zip(b["_group"].to_pylist(), b["_text"].to_pylist(), strict=True)):
                if t and g in shared.value:
                    named = {r for _, rules in automaton(g).iter(t.translate(ASCII_LOWER)) for r in rules}
                    row += [i] * len(named)
                    found += named
            some = b.select(columns).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, arrow)], names=[*columns, rule])

    return rows.mapInArrow(run, schema)


def matching_pairs(texts: DataFrame, rules: DataFrame, group: str, text: str, rule: str, pattern: str, columns: list[str]) -> DataFrame:
    """columns of texts and the rule of each pair of one group whose pattern is found in the text, regardless of case (A-Z).

    columns identify a text's row. Null texts and null patterns match nothing; an empty pattern matches every text. Equal texts and
    equal patterns of a group are judged once; a text's row then meets lists of the rules that have the pattern.
    """
    known = rules.where(F.col(group).isNotNull() & F.col(pattern).isNotNull()).select(group, rule, F.col(pattern).alias("_pattern"))
    patterns = known.select(group, "_pattern").distinct().withColumn("_literals", required_literals("_pattern"))
    literals = patterns.where("_literals IS NOT NULL").select(group, "_pattern", F.explode("_literals").alias("literal"))
    there = texts.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(*dict.fromkeys([*columns, group, text]))
    once = there.select(group, text).distinct()
    named = hits(once, literals, group, text, "_pattern", [group, text])
    apart = once.join(patterns.where("_literals IS NULL").select(group, "_pattern"), group)
    judged = named.unionByName(apart.select(*named.columns)).where(F.regexp_like(F.col(text), F.concat(F.lit("(?i)"), "_pattern")))
    # What follows is as many rows as there are pairs, which no estimate of Spark's knows: no side of it may be broadcast.
    of_text = judged.join(there.hint("merge"), [group, text]).select(*dict.fromkeys([*columns, group]), "_pattern")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = known.withColumn("_list", F.floor(F.row_number().over(Window.partitionBy(group, "_pattern").orderBy(rule)) / MOST_LISTED)).groupBy(group, "_pattern", "_list").agg(F.collect_list(rule).alias("_rules"))
    # Few patterns may have most of the rows: these are dealt over all tasks, each of which has the lists.
    dealt = of_text.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(parts)))
    each = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    return dealt.join(each.hint("merge"), [group, "_pattern", "_part"]).select(*columns, F.explode("_rules").alias(rule))
