"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are Spark expressions. From labelled rows, rules that mark poor
texts are grown one threshold at a time and pruned on held-back rows; rows that a rule
covers leave, and the next rule is sought among the rest. The list comes out as one
ordered conditional expression, which Spark evaluates over the whole corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import checkpoint, fresh, words

#: Labelled rows that a fit looks at, at most: those whose ids come first in md5 order.
FIT_ROWS = 20_000
#: The ratios that conditions test, all computed from the base counts.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share"]


def _let(value: Column, body) -> Column:
    """Binds ``value`` to a lambda variable, so that it is evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first included.

    Windows are compared by a 64-bit hash. They are sorted with their positions once;
    equal neighbours give the positions, and these the length of the union of the windows.
    Texts without a repeat stop after one set operation.
    """
    n = F.size(tokens)

    def count(grams: Column) -> Column:
        def marked(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"]))
            places = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n"))
            return F.aggregate(places, zero, step, lambda a: a["n"])

        sorted_grams = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(sorted_grams, marked))

    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(tokens[i], tokens[i + 1], tokens[i + 2]))
    return F.when(n < 4, F.lit(0)).otherwise(_let(grams, count))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A null or blank text has zero of each. Columns of these names are replaced.
    """
    clear = F.coalesce(F.col(text), F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split(clear, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    by_words = lambda w: F.struct(
        F.size(w).alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    )
    name = fresh("by_words")
    counted = docs.withColumn(name, _let(words(F.col(text)), by_words))
    return counted.withColumns(
        {
            "n_words": F.col(f"{name}.n_words").cast("long"),
            "word_chars": F.col(f"{name}.word_chars").cast("long"),
            "n_symbols": F.length(F.regexp_replace(clear, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": _let(lines, of_lines).cast("long"),
            "n_repeat_words": F.col(f"{name}.n_repeat_words").cast("long"),
        }
    ).drop(name)


def feature_columns() -> dict[str, Column]:
    """Ratios of the base counts; 0 where a text has no word."""
    per = lambda c, d: F.when(F.col(d) > 0, F.col(c) / F.col(d)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, float]


def _holds(row: dict, rule: list[Condition]) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in rule)


def _thresholds(values: list[float], most: int = 24) -> list[float]:
    """Middles between neighbouring quantiles."""
    u = sorted(set(values))
    if len(u) < 2:
        return []
    step = max(1, (len(u) - 1) // most)
    return [(u[i] + u[i + 1]) / 2 for i in range(0, len(u) - 1, step)]


def _grow(rows: list[tuple[dict, bool]], features: list[str], most: int) -> list[Condition]:
    """Adds the condition with the highest gain (as FOIL measures it) until no negative is covered."""
    rule: list[Condition] = []
    covered = rows
    while len(rule) < most:
        p0 = sum(y for _, y in covered)
        n0 = len(covered) - p0
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in features:
            total = sorted((x[f], y) for x, y in covered)
            cuts, below, k, p = _thresholds([v for v, _ in total]), [], 0, 0
            for t in cuts:
                while k < len(total) and total[k][0] <= t:
                    p += total[k][1]
                    k += 1
                below.append((t, p, k - p))
            for t, bp, bn in below:
                for op, pos, neg in (("<=", bp, bn), (">", p0 - bp, n0 - bn)):
                    if pos and (gain := pos * (math.log2(pos / (pos + neg)) - base)) > best[0]:
                        best = (gain, (f, op, t))
        if best[1] is None:
            break
        rule.append(best[1])
        covered = [r for r in covered if _holds(r[0], rule)]
    return rule


def _worth(rows: list[tuple[dict, bool]], rule: list[Condition]) -> float:
    hit = [y for x, y in rows if _holds(x, rule)]
    return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0


def learn_decision_list(rows: list[tuple[dict, bool]], features: list[str] = FEATURES, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 3) -> list[list[Condition]]:
    """Rules for poor rows (label True), in order.

    Every third row is held back for pruning: final conditions go while that doesn't lower
    (p - n) / (p + n) there. A rule enters while it covers ``min_cover`` poor rows and its
    precision over all remaining rows reaches ``min_precision``. No rows or one class: no rules.
    """
    rules: list[list[Condition]] = []
    left = list(rows)
    while len(rules) < max_rules and any(y for _, y in left):
        rule = _grow([r for i, r in enumerate(left) if i % 3], features, max_conditions)
        held = [r for i, r in enumerate(left) if not i % 3]
        while len(rule) > 1 and _worth(held, rule[:-1]) >= _worth(held, rule):
            rule = rule[:-1]
        hit = [y for x, y in left if _holds(x, rule)] if rule else []
        if sum(hit) < min_cover or sum(hit) < min_precision * len(hit):
            break
        rules.append(rule)
        left = [r for r in left if not _holds(r[0], rule)]
    return rules


def as_column(rules: list[list[Condition]], features: dict[str, Column]) -> Column:
    """The number of the first rule that fires, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, op, t in rule:
            test = test & (features[f] <= t if op == "<=" else features[f] > t)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[list[Condition]]:
    """A decision list from labelled documents that pass the base rules.

    The fit sees at most ``fit_rows`` labelled rows, the first in md5 order of the ids; only
    their statistics, a few numbers a row, come to the driver. Rows with a null label, or with
    labels that contradict each other, are left out.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
        .filter("quality = _other")
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(fit_rows)
        .select("doc_id", "quality")
    )
    # fit_rows rows at most; written first, as Spark would else put the base rules, and with them all statistics, below the join
    known = checkpoint(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    stats = text_statistics(known).filter(~base_failed())
    rows = stats.select("doc_id", "quality", *[c.alias(f"f_{k}") for k, c in feature_columns().items()]).collect()
    rows.sort(key=lambda r: tuple(r[f"f_{k}"] for k in FEATURES) + (r["doc_id"],))
    # spread over the folds by id, not by the order of the statistics
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761) % 4294967296)
    return learn_decision_list([({k: r[f"f_{k}"] for k in FEATURES}, r["quality"] == 0) for r in rows])


def judge_quality(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Every row with its statistics, base_failed, the rule that fired (0: none) and kept."""
    judged = text_statistics(docs).withColumn("base_failed", base_failed())
    judged = judged.withColumn("rule", as_column(rules, feature_columns()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
