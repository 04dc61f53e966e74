"""What listeners ask for: rules over messages, precedence of rules, decisions from scores, the state they lead to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions.text import chat_features, clean, fnv1a

def phrases_found(text: Column, vocabulary: list[str] | tuple[str, ...] | Column) -> Column:
    """The phrases of the vocabulary (or of an array of phrases) in a text as whole words, longest first; what one has used
    is not found again."""
    start = F.struct(F.concat(F.lit(" "), clean(text), F.lit(" ")).alias("t"), F.array().cast("array<string>").alias("f"))
    if isinstance(vocabulary, Column):
        words = F.transform(F.array_sort(F.transform(vocabulary, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
    else:
        words = F.array(*[F.lit(v) for v in sorted(vocabulary, key=lambda v: (-len(v), v))])

    def take(acc: Column, v: Column) -> Column:
        key = F.concat(F.lit(" "), v, F.lit(" "))
        hit = F.contains(acc["t"], key)
        return F.struct(F.when(hit, F.replace(acc["t"], key, F.lit(" "))).otherwise(acc["t"]).alias("t"), F.when(hit, F.concat(acc["f"], F.array(v))).otherwise(acc["f"]).alias("f"))

    return F.aggregate(words, start, take, lambda acc: acc["f"])


def with_precedence(rules: DataFrame, model: DataFrame, keys: list[str], alone: str) -> DataFrame:
    """(keys, head, label): what rules say, and the model's labels for heads that no rule covers; its label of the head
    `alone` counts only where no rule says anything."""
    free = model.join(rules.select(*keys, "head"), [*keys, "head"], "left_anti")
    silent = free.where(F.col("head") == alone).join(rules.select(*keys).distinct(), keys, "left_anti")
    return rules.unionByName(free.where(F.col("head") != alone)).unionByName(silent)


def decide(scores: DataFrame, keys: list[str], clause_least: float, full_least: float) -> DataFrame:
    """(keys, head, label) from rows (keys, head, clause, label, p), clause 0 being the whole message.

    The surest label of a clause counts if it reaches its threshold, else the whole message's; label 0 is none.
    """
    best = scores.groupBy(*keys, "head", "clause").agg(F.max(F.struct("p", (-F.col("label")).alias("l"))).alias("b"))
    best = best.select(*keys, "head", "clause", F.col("b.p").alias("p"), (-F.col("b.l")).alias("label"))
    part = F.when((F.col("clause") > 0) & (F.col("label") > 0), F.struct("p", (-F.col("clause")).alias("c"), "label"))
    whole = F.when(F.col("clause") == 0, F.struct("p", "label"))
    both = best.groupBy(*keys, "head").agg(F.max(part).alias("c"), F.max(whole).alias("f"))
    label = F.when(F.col("c.p") >= clause_least, F.col("c.label")).when((F.col("f.label") > 0) & (F.col("f.p") >= full_least), F.col("f.label")).otherwise(0)
    return both.select(*keys, "head", label.alias("label"))


def linear_scores(messages: DataFrame, column: str, heads: int, labels: int, seed: int, buckets: int = 32768) -> DataFrame:
    """Softmax scores per head of a linear model over hashed features; its weights are drawn from the seed."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 0.5, (buckets + 1, heads * labels)).astype(np.float32)
    ids = F.transform(chat_features(F.col(column)), lambda f: fnv1a(f) % buckets + 1)
    rows = messages.select(*[c for c in messages.columns if c != column], ids.alias("ids"))
    keep = [c for c in rows.columns if c != "ids"]

    def run(it):
        for pdf in it:
            out = []
            for i, x in enumerate(pdf["ids"]):
                z = weights[np.asarray(x, np.int64)].mean(0) if len(x) else weights[0]
                z = np.exp(z.reshape(heads, labels) - z.reshape(heads, labels).max(1, keepdims=True))
                out.append((z / z.sum(1, keepdims=True)).ravel().astype(float).tolist())
            yield pdf[keep].assign(scores=pd.Series(out, index=pdf.index, dtype=object))

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "ids") + ", scores array<double>"
    return rows.mapInPandas(run, schema)


def applied(actions: DataFrame, user: str, order: str) -> DataFrame:
    """(user, state, applied, failed): the options that a user's actions lead to, in order.

    actions: key and value; key 'undo' takes back the last change that still stands, an action without a value fails by
    itself and changes nothing. state: key to value. A user's actions are gathered: as many as one person has made.
    """
    kind = "struct<stack:array<struct<key:string,value:string>>,failed:int>"
    rows = actions.groupBy(user).agg(F.sort_array(F.collect_list(F.struct(order, "key", "value"))).alias("_a"))
    empty = F.struct(F.array().cast("array<struct<key:string,value:string>>").alias("stack"), F.lit(0).alias("failed")).cast(kind)

    def step(s: Column, a: Column) -> Column:
        undo, bad = a["key"] == "undo", a["value"].isNull()
        kept = F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))
        more = F.array_append(s["stack"], F.struct(a["key"].alias("key"), a["value"].alias("value")))
        stack = F.when(undo, kept).when(bad, s["stack"]).otherwise(more)
        return F.struct(stack.alias("stack"), (s["failed"] + F.when(~undo & bad, 1).otherwise(0)).alias("failed")).cast(kind)

    folded = rows.select(user, F.aggregate("_a", empty, step).alias("s"))
    # of several changes to a key, the last one holds
    last = F.filter(F.col("s.stack"), lambda x, i: ~F.exists(F.slice("s.stack", i + 2, F.size("s.stack")), lambda y: y["key"] == x["key"]))
    state = F.map_from_entries(F.array_sort(last))
    return folded.select(user, state.alias("state"), F.size("s.stack").alias("applied"), F.col("s.failed").alias("failed"))


def _draw(column: str, seed: int, k: int) -> Column:
    """A number from 0 to 1 drawn from a text, a seed and a counter."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(column), F.lit("")), F.lit(str(seed)), F.lit(str(k)))), 1, 7)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 28)


def _typo(s: Column, where: Column, place: Column, kind: Column) -> Column:
    """A letter inside one of the words of five letters or more swapped with the next (0.4), left out (0.3) or doubled (0.3);
    the draws tell which word, which letter and which of these. Without such a word the text stays."""
    words = F.split(s, " ")
    long = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.length(F.get(words, i)) >= 5)
    chosen = F.get(long, F.floor(where * F.size(long)).cast("int"))
    word = F.get(words, chosen)
    j = (1 + F.floor(place * (F.length(word) - 2))).cast("int")
    rest, letter = F.length(word), F.substring(word, j + 1, F.lit(1))
    start, after = F.substring(word, F.lit(1), j), F.substring(word, j + 2, rest)
    swapped = F.concat(start, F.substring(word, j + 2, F.lit(1)), letter, F.substring(word, j + 3, rest))
    changed = F.when(kind < 0.4, swapped).when(kind < 0.7, F.concat(start, after)).otherwise(F.concat(start, letter, letter, after))
    return F.when(F.size(long) > 0, F.array_join(F.transform(words, lambda w, i: F.when(i == chosen, changed).otherwise(w)), " ")).otherwise(s)


def noisy(messages: DataFrame, column: str, seed: int, before: list[str], behind: list[str], first: float = 0.15, second: float = 0.05) -> DataFrame:
    """messages with `noisy`: the text with a phrase before and one behind it, one typing error with a probability of
    `first`, another with `second`. All draws come from the text and the seed, so equal texts get equal noise; null stays
    null."""

    def phrase(options: list[str], k: int) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in options]), (F.floor(_draw(column, seed, k) * len(options)) + 1).cast("int"))

    out = messages.withColumn("noisy", F.concat(phrase(before, 0), F.col(column), phrase(behind, 1)))
    for chance, k in ((first, 2), (second, 6)):
        draws = [_draw(column, seed, k + i) for i in (1, 2, 3)]
        out = out.withColumn("noisy", F.when(_draw(column, seed, k) < chance, _typo(F.col("noisy"), *draws)).otherwise(F.col("noisy")))
    return out


def tuned_thresholds(rows: DataFrame, clause_grid: tuple[float, ...], full_grid: tuple[float, ...], last: str = "talk", penalty: int = 3) -> DataFrame:
    """(head, clause, full, score): for each head the pair of thresholds with the most right answers less penalty times wrong ones.

    rows: message, head, truth, rule, clause_p, clause_label, full_p, full_label; labels are 0 or null for none. A rule's label stands
    before the model's. The model gives the label of the surest clause if its probability reaches the first threshold, else
    that of the whole message if it reaches the second. The head `last` counts only in messages in which no other head says
    anything, unless a rule does: it is tuned after the others, with their thresholds. Of equal pairs the first of the grids is taken.

    The scores of all pairs follow from one histogram of how many thresholds each row reaches, so rows are read once for
    the heads that stand by themselves and once for the last. As those don't depend on each other, going through the heads
    again changes nothing.
    """
    grids = rows.sparkSession.createDataFrame([(i, j, c, f) for i, c in enumerate(clause_grid) for j, f in enumerate(full_grid)], "i int, j int, clause double, full double")
    gain = lambda label: F.when(F.coalesce(label, F.lit(0)) == 0, 0).when(label == F.col("truth"), 1).otherwise(-penalty)
    reached = lambda p, grid: F.aggregate(F.array(*[F.lit(float(g)) for g in grid]), F.lit(0), lambda n, g: n + (F.coalesce(p, F.lit(-1.0)) >= g).cast("int"))

    def best(some: DataFrame) -> DataFrame:
        """Grids ascend: a row that reaches n thresholds reaches the first n."""
        by_rule = F.col("rule") > 0
        told = some.select(
            "head", F.when(by_rule | (F.coalesce("clause_label", F.lit(0)) == 0), 0).otherwise(reached(F.col("clause_p"), clause_grid)).alias("c"), F.when(by_rule, 0).otherwise(reached(F.col("full_p"), full_grid)).alias("f"),
            gain(F.col("clause_label")).alias("by_clause"), gain(F.col("full_label")).alias("by_full"), F.when(by_rule, gain(F.col("rule"))).otherwise(0).alias("by_rule"),
        )
        bins = told.groupBy("head", "c", "f").agg(*[F.sum(x).alias(x) for x in ("by_clause", "by_full", "by_rule")])
        value = F.col("by_rule") + F.when(F.col("c") > F.col("i"), F.col("by_clause")).when(F.col("f") > F.col("j"), F.col("by_full")).otherwise(0)
        scores = bins.crossJoin(F.broadcast(grids)).groupBy("head", "i", "j", "clause", "full").agg(F.sum(value).alias("score"))
        top = F.max(F.struct("score", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "clause", "full")).alias("t")
        return scores.groupBy("head").agg(top).select("head", "t.clause", "t.full", F.col("t.score").cast("long").alias("score"))

    first = best(rows.where(F.col("head") != last))
    known = rows.where(F.col("head") != last).join(F.broadcast(first.select("head", "clause", "full")), "head")  # a row for each head
    by_clause = (F.coalesce("clause_label", F.lit(0)) > 0) & (F.col("clause_p") >= F.col("clause"))
    says = F.when(F.col("rule") > 0, True).when(by_clause, True).otherwise((F.coalesce("full_label", F.lit(0)) > 0) & (F.coalesce("full_p", F.lit(-1.0)) >= F.col("full")))
    speaking = known.where(F.coalesce(says, F.lit(False))).select("message").distinct().withColumn("_speaks", F.lit(True))
    rest = rows.where(F.col("head") == last).join(speaking, "message", "left")
    silenced = [F.when(F.col("_speaks").isNull(), F.col(c)).alias(c) for c in ("clause_label", "full_label")]
    return first.unionByName(best(rest.select("message", "head", "truth", "rule", "clause_p", "full_p", *silenced)))
