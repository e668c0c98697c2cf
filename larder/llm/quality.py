"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as in the pattern [^\\x20\\x09-\\x0D]+ of a word.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a repeated passage.
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be at by this from or an not "
    "der die das und von den dem mit ist ein eine nicht auch für auf sich des als "
    "le la les de des et un une que qui dans pour par sur est avec au du "
    "el los las del en y se con para una al no su es por"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if least <= share <= most, or if its base count is zero; None sets no limit."""

    name: str
    count: str
    base: str
    least: float | None = None
    most: float | None = None
    #: The rule holds from this many words on.
    words: int = 0


#: The production thresholds. The base rules of the contract come first; the others are the verdict's.
RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.25),
    Rule("shouts_per_word", "n_shouts", "n_words", most=0.25),
    Rule("chars_per_word", "word_chars", "n_words", least=1.5, most=40.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("stop_words", "n_stop", "n_words", least=0.02, words=50),
)


def _chars_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` plus a struct `m` of the counts that the rules speak of, by built-in functions alone.

    A null text has no words and no lines. The repeated words of a text are found from the hashes of its
    five-word windows: a text whose windows all differ, as most do, is done after one pass; else the
    windows are sorted, and each found twice covers its words once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.withColumn("_text", text)
    step = step.withColumn("_words", F.expr("filter(split(translate(_text, '\t\n\x0b\x0c\r', '     '), ' +'), w -> w <> '')"))
    step = step.withColumn("_lines", F.expr("filter(split(_text, '\n'), l -> translate(l, ' \t\x0b\x0c\r', '') <> '')"))
    step = step.withColumn("_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
    window = ", ".join(f"get(_hashes, i + {k})" for k in range(WINDOW))
    step = step.withColumn("_windows", F.expr(
        f"if(size(_hashes) >= {WINDOW}, transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({window})), array())"))
    step = step.withColumn("_sorted", F.expr(
        "if(size(array_distinct(_windows)) < size(_windows), sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))), array())"))
    step = step.withColumn("_twice", F.expr(
        "if(size(_sorted) > 0, sort_array(transform(filter(sequence(0, size(_sorted) - 1),"
        " k -> get(_sorted, k).h <=> get(_sorted, k - 1).h or get(_sorted, k).h <=> get(_sorted, k + 1).h),"
        " k -> get(_sorted, k).i)), array())"))
    repeats = (
        f"if(size(_twice) > 0, {WINDOW} + aggregate(sequence(0, size(_twice) - 1), 0,"
        f" (sum, k) -> sum + if(k > 0, least({WINDOW}, get(_twice, k) - get(_twice, k - 1)), 0)), 0)"
    )
    length = F.length("_text")
    stop = F.filter("_words", lambda word: F.lower(word).isin(STOP_WORDS))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": _chars_without(F.col("_text"), WHITE),
        "n_symbols": length - _chars_without(F.col("_text"), SYMBOLS),
        "n_shouts": length - _chars_without(F.col("_text"), "!"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.expr(repeats),
        "n_stop": F.size(stop),
    }
    step = step.withColumn("m", F.struct(*[value.cast("long").alias(name) for name, value in counts.items()]))
    return step.select(*[docs[name] for name in docs.columns], "m")


def base_failed(m: str = "m") -> Column:
    return F.expr(f"{m}.n_words < 10 or 100 * {m}.n_repeat_words > 20 * {m}.n_words")


def passes(rules: tuple[Rule, ...], m: str = "m") -> Column:
    """The table of rules as one condition."""
    good = F.lit(True)
    for rule in rules:
        share = F.col(f"{m}.{rule.count}") / F.col(f"{m}.{rule.base}")
        inside = F.lit(True)
        if rule.least is not None:
            inside &= share >= rule.least
        if rule.most is not None:
            inside &= share <= rule.most
        idle = (F.col(f"{m}.{rule.base}") == 0) | (F.col(f"{m}.n_words") < rule.words)
        good &= F.when(idle, True).otherwise(inside)
    return good


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` plus `m` (the counts), `base_failed` and `kept`.

    A text fails the base with under ten words, or if more than a fifth of them lie in repeated five-word windows;
    it is kept if it does not fail the base and passes every rule. Null and empty texts fail the base.
    Rows are judged alone, so repeated rows and null ids change nothing. Columns of `docs` named m,
    base_failed, kept or starting with an underscore are replaced or dropped.
    """
    names = [c for c in docs.columns if c.lower() not in ("m", "base_failed", "kept") and not c.startswith("_")]
    out = measured(docs.select(*[docs[name] for name in names]), text_col)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & passes(rules))


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with the columns of `docs`.

    A filter on the counts alone would be pushed below their projection, where each of its terms counts the text anew.
    The row number, which cannot be computed twice, keeps it above. Columns that start with an underscore are dropped.
    """
    names = [c for c in docs.columns if not c.startswith("_")]
    counted = measured(docs.select(*names, F.col(text_col).alias("_source")), "_source").withColumnRenamed("m", "_m")
    counted = counted.withColumn("_row", F.monotonically_increasing_id())
    return counted.where((F.col("_row") >= 0) & ~base_failed("_m") & passes(rules, "_m")).select(*names)


def sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The query's result in SQL, from the same table of rules."""
    conditions = []
    for rule in rules:
        share = f"cast({rule.count} as double) / nullif({rule.base}, 0)"
        limits = [f"{share} >= {rule.least}"] * (rule.least is not None) + [f"{share} <= {rule.most}"] * (rule.most is not None)
        conditions.append(f"({rule.base} = 0 or n_words < {rule.words} or ({' and '.join(limits)}))")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
with d as (select doc_id, coalesce(text, '') as text from {table}),
w as (
  select doc_id, text,
    [x for x in string_split_regex(text, '[\\x20\\x09-\\x0D]+') if x <> ''] as words,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as lines
  from d),
g as (
  select doc_id, i, array_to_string(words[i:i + 4], ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5) as s),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) as c where n > 1),
c as (
  select doc_id, sum(case when p is null then 5 else least(5, i - p) end) as n
  from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from r) as o group by doc_id),
m as (
  select w.doc_id, cast(len(words) as bigint) as n_words,
    cast(coalesce(length(array_to_string(words, '')), 0) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(length(text) - length(replace(text, '!', '')) as bigint) as n_shouts,
    cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    cast(len([x for x in words if lower(x) in ({stop})]) as bigint) as n_stop
  from w left join c on w.doc_id = c.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and {' and '.join(conditions)} as kept
from m"""
