"""Operator 2, quality rules: how far a text's histograms lie from those of its language, by Jensen-Shannon distance.

Two histograms are compared: characters by class, and words by which of the language's common words they are. References
are the mean shares over the corpus's own passable documents of the language. Short texts are exempt, as their histograms
are mostly noise. Only DataFrame and SQL functions run; texts are read once, and what follows uses a narrow table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import written

#: The most common words of the languages, which hardly depend on the topic.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not this are or".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas ne".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
OTHER = "other"
SPACES = r"[\\x20\\x09-\\x0D]"
CHARS = ("lower", "space", "upper", "digit", "symbol", "mark", "line", "rest")
#: What is taken off either end of a word before it is compared with the common ones.
MARKS = ".,;:!?\"()[]{}|#*$%&<>-"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = ("[a-z]+", " +", "[A-Z]+", "[0-9]+", r"[#*$%&|<>]+", r"[.,;:!?\'\"()-]+", r"[\\x09-\\x0D]+")


def _let(value: str, name: str, body: str) -> str:
    """SQL for body, in which name stands for value; value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str = "words") -> str:
    """SQL for the words that lie in five-word windows found twice or more.

    Windows compare by a 64-bit hash. Where there are as many hashes as distinct ones nothing repeats; else they are
    sorted, and each window with an equal neighbour covers five words less what the one before it covered."""
    window = f"xxhash64({', '.join(f'{words}[i + {k}]' for k in range(5))})"
    hashes = f"if(size({words}) < 5, cast(array() as array<bigint>), transform(sequence(0, size({words}) - 5), i -> {window}))"
    ordered = "array_sort(transform(hs, (h, i) -> struct(h, i)))"
    twice = "transform(filter(o, (x, k) -> (k > 0 and o[k - 1].h = x.h) or (k < size(o) - 1 and o[k + 1].h = x.h)), x -> x.i)"
    covered = "aggregate(at, named_struct('last', -9, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(5, i - a.last)), a -> a.n)"
    return _let(hashes, "hs", f"if(size(array_distinct(hs)) = size(hs), 0L, {_let(ordered, 'o', _let(f'array_sort({twice})', 'at', covered))})")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, language (of COMMON, or OTHER), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars and common.

    chars: characters of each class of CHARS. common: words that are the language's first, second ... common word, without
    case (A-Z) and without MARKS around them; all others come last."""
    known = F.lower(docs["lang"].cast("string"))
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), F.when(known.isin(*COMMON), known).otherwise(F.lit(OTHER)).alias("language"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("t0")
    )
    for k, pattern in enumerate(_STEPS):
        rows = rows.withColumn(f"t{k + 1}", F.expr(f"regexp_replace(t{k}, '{pattern}', '')"))
    lists = "CASE language " + " ".join(f"WHEN '{k}' THEN array({', '.join(map(repr, v))})" for k, v in COMMON.items()) + " ELSE cast(array() as array<string>) END"
    rows = rows.withColumn("words", F.expr(f"filter(split(t0, '{SPACES}+'), w -> w != '')"))
    marks = "[" + "".join(f"\\\\{c}" for c in MARKS) + "]*"
    plain = f"split(concat(' ', translate(t0, '{_UPPER}', '{_LOWER}'), ' '), '{marks}{SPACES}+{marks}')"
    rows = rows.withColumn("ranks", F.expr(_let(lists, "c", f"filter(transform({plain}, w -> array_position(c, w)), p -> p > 0)")))
    lines = f"filter(split(t0, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    size = [F.length(f"t{k}") for k in range(len(CHARS))]
    chars = F.array(*(size[k] - size[k + 1] for k in range(len(CHARS) - 1)), size[-1])
    per_word = F.array(*(F.size("ranks") - F.size(F.array_remove("ranks", k)) for k in range(1, 21)))
    return rows.select(
        "doc_id", "language", F.size("words").cast("bigint").alias("n_words"), (size[0] - (size[1] - size[2]) - (size[6] - size[7])).cast("bigint").alias("word_chars"),
        (size[4] - size[5]).cast("bigint").alias("n_symbols"), F.expr(_let(lines, "l", "size(l) - size(array_distinct(l))")).cast("bigint").alias("n_dup_lines"),
        F.expr(_repeat_words()).alias("n_repeat_words"), chars.alias("chars"), F.array_append(per_word, F.size("words") - F.size("ranks")).alias("common"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def _shares(counts: str) -> str:
    return _let(f"aggregate({counts}, 0L, (a, v) -> a + v)", "s", f"transform({counts}, v -> if(s = 0, 0D, v / cast(s as double)))")


def _distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance in bits, 0 to 1: the root of the divergence."""
    term = "(if(x > 0, x * log2(2 * x / (x + y)), 0D) + if(y > 0, y * log2(2 * y / (x + y)), 0D)) / 2"
    return f"sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (x, y) -> {term}), 0D, (a, v) -> a + v)))"


def judge(docs: DataFrame, most_chars: float = 0.22, most_common: float = 0.35, least_chars: int = 200, least_words: int = 50) -> DataFrame:
    """The statistics of each row of docs with base_failed, chars_distance, common_distance and kept.

    kept: not base_failed, chars_distance at most most_chars (texts of least_chars characters in words and more) and
    common_distance at most most_common (texts of least_words words and more; languages of COMMON). References of a language
    come from its texts that don't fail the base and have least_words words; one without such texts has no distances (null),
    and nothing goes for them. Null and empty texts have no words, so they fail the base. Null and unknown languages share
    one reference. Rows with repeated or null ids are judged each. At most a row per language of COMMON and one is broadcast.
    Distances are rounded to six digits, so that the order of sums decides nothing."""
    stats = written(statistics(docs).withColumn("base_failed", base_failed()))
    sure = stats.where(f"not base_failed and n_words >= {least_words}")
    shares = sure.select("language", F.expr(_shares("chars")).alias("c"), F.expr(_shares("common")).alias("w"))
    means = shares.groupBy("language").agg(F.array(*(F.avg(F.col("c")[k]) for k in range(len(CHARS)))).alias("__c"), F.array(*(F.avg(F.col("w")[k]) for k in range(21))).alias("__w"))
    told = stats.join(F.broadcast(means), "language", "left")
    told = told.withColumn("chars_distance", F.expr(f"if(__c is null, null, round({_distance(_shares('chars'), '__c')}, 6))"))
    told = told.withColumn("common_distance", F.expr(f"if(__w is null or language = '{OTHER}', null, round({_distance(_shares('common'), '__w')}, 6))"))
    far = f"(word_chars >= {least_chars} and coalesce(chars_distance, 0) > {most_chars}) or (n_words >= {least_words} and coalesce(common_distance, 0) > {most_common})"
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"not base_failed and not ({far})").alias("kept"), "language", "chars_distance", "common_distance"
    )


def judge_sql(most_chars: float = 0.22, most_common: float = 0.35, least_chars: int = 200, least_words: int = 50) -> str:
    """DuckDB SQL for the rows of judge over the table documents: windows and histograms by unnesting instead of by array."""
    word, lists = r"[\x20\x09-\x0D]", ", ".join(f"'{k}': {v!r}" for k, v in COMMON.items())
    patterns = ["[a-z]+", " +", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", "[.,;:!?''\"()-]+", r"[\x09-\x0D]+"]
    stages = [f"s{k + 1} AS (SELECT *, regexp_replace(t{k}, '{p}', '', 'g') AS t{k + 1} FROM {f's{k}' if k else 'd'})" for k, p in enumerate(patterns)]
    chars = ", ".join([*(f"length(t{k}) - length(t{k + 1})" for k in range(7)), "length(t7)"])

    def distance(p: str, q: str, n: int) -> str:
        term = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
        return f"round(sqrt(greatest(0, {' + '.join(f'({term(f"{p}[{k}]", f"{q}[{k}]")} + {term(f"{q}[{k}]", f"{p}[{k}]")}) / 2' for k in range(1, n + 1))})), 6)"

    marks = "[" + "".join(f"\\{c}" for c in MARKS) + "]*"
    plain = f"regexp_split_to_array(' ' || translate(t0, '{_UPPER}', '{_LOWER}') || ' ', '{marks}{word}+{marks}')"
    mean = lambda c, n: f"[{', '.join(f'avg({c}[{k}])' for k in range(1, n + 1))}]"
    far = f"(word_chars >= {least_chars} AND coalesce(chars_distance, 0) > {most_chars}) OR (n_words >= {least_words} AND coalesce(common_distance, 0) > {most_common})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t0, CASE WHEN lower(lang) IN ({", ".join(map(repr, COMMON))}) THEN lower(lang) ELSE '{OTHER}' END AS language FROM documents),
w AS (SELECT r, {plain} AS v, list_filter(regexp_split_to_array(t0, '{word}+'), lambda x: x <> '') AS w, list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
{", ".join(stages)},
m AS (SELECT s7.r, doc_id, language, [{chars}] AS chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t4) - length(t5) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
  list_transform(range(1, 21), lambda k: CASE WHEN language = '{OTHER}' THEN 0 ELSE len(list_filter(v, lambda x: x = MAP {{{lists}}}[language][k])) END) AS c FROM s7 JOIN w USING (r) LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_append(c, n_words - list_sum(c)) AS common FROM m),
p AS (SELECT *, list_transform(chars, lambda v: CASE WHEN list_sum(chars) = 0 THEN 0 ELSE v / list_sum(chars) END) AS ps, list_transform(common, lambda v: CASE WHEN n_words = 0 THEN 0 ELSE v / n_words END) AS ws FROM b),
q AS (SELECT language, {mean("ps", 8)} AS qc, {mean("ws", 21)} AS qw FROM p WHERE NOT base_failed AND n_words >= {least_words} GROUP BY language),
j AS (SELECT p.*, CASE WHEN qc IS NOT NULL THEN {distance("ps", "qc", 8)} END AS chars_distance, CASE WHEN qw IS NOT NULL AND language <> '{OTHER}' THEN {distance("ws", "qw", 21)} END AS common_distance FROM p LEFT JOIN q USING (language))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT ({far}) AS kept, language, chars_distance, common_distance FROM j"""
