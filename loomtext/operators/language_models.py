"""N-gram language models as count tables and expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.tokenizers import ngram_structs


def padded(tokens: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit("<s>"), order - 1), tokens, F.array(F.lit("</s>")))


def fit(docs: DataFrame, tokens: Column, order: int = 2) -> DataFrame:
    """L1: context (array), word, count; each text is one sentence. Null tokens are left out.

    Models are joined with sums of themselves. Joins infer that what they compare isn't null for one of their sides; said here, below the
    count, all parts stay equal and share its scan and its shuffle.
    """
    names = [f"w{i}" for i in range(1, order + 1)]
    g = docs.select(padded(tokens, order).alias("t")).select(F.inline(ngram_structs(F.col("t"), order, *names)))
    for name in names:
        g = g.filter(F.col(name).isNotNull())
    counted = g.groupBy(*names).agg(F.count(F.lit(1)).alias("count"))
    return counted.select((F.array(*names[:-1]) if order > 1 else F.array().cast("array<string>")).alias("context"), F.col(names[-1]).alias("word"), "count")


def scores(model: DataFrame, method: str = "mle", gamma: float = 0.1) -> DataFrame:
    """Context, word, count, score of seen n-grams. method: mle, laplace, lidstone."""
    total = model.groupBy("context").agg(F.sum("count").alias("total"))
    joined = model.join(total, "context")
    if method == "mle":
        return joined.select("context", "word", "count", (F.col("count") / F.col("total")).alias("score"))
    g = {"laplace": 1.0, "lidstone": gamma}[method]
    return joined.crossJoin(F.broadcast(vocabulary_size(model))).select("context", "word", "count", ((F.col("count") + g) / (F.col("total") + g * F.col("v"))).alias("score"))


def unigram_scores(words: DataFrame, method: str, discount: float = 0.75, alpha: float = 0.4) -> DataFrame:
    """L7 - L9 over (sample, count): kneser_ney, witten_bell or stupid_backoff in their unigram form; sample, score."""
    t = words.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"))
    c, n, v = F.col("count"), F.col("n"), F.col("v")
    value = {
        "kneser_ney": F.greatest(c - discount, F.lit(0.0)) / n + (discount * v / n) / v,
        "witten_bell": c / (n + v),
        "stupid_backoff": c / n,
    }[method]
    return words.crossJoin(F.broadcast(t)).select("sample", value.alias("score"))


def kneser_ney(model: DataFrame, discount: float = 0.75) -> DataFrame:
    """Interpolated Kneser-Ney of order 2 (published form): context, word, score of seen bigrams."""
    bigrams = model.filter(F.size("context") == 1).select(F.col("context")[0].alias("h"), "word", "count")
    some = F.when(F.col("count") > 0, 1)  # each of them: a part that didn't read the count would be another aggregation
    by_h = bigrams.groupBy("h").agg(F.sum("count").alias("total"), F.count(some).alias("kinds"))
    before = bigrams.groupBy("word").agg(F.count(some).alias("histories"))
    kinds = before.agg(F.sum("histories").alias("all"))
    j = bigrams.join(by_h, "h").join(before, "word").crossJoin(F.broadcast(kinds))
    p = F.greatest(F.col("count") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("kinds") / F.col("total") * F.col("histories") / F.col("all")
    return j.select("h", "word", p.alias("score"))


def with_context(rows: DataFrame, order: int, context: str = "context") -> DataFrame:
    """L2: contexts of order - 1 words: longer ones are cut at the left, shorter ones padded with start marks."""
    n = order - 1
    c = F.coalesce(F.col(context), F.array().cast("array<string>"))
    padded_ = F.concat(F.array_repeat(F.lit("<s>"), n), c)
    return rows.withColumn(context, F.slice(padded_, F.size(padded_) - n + 1, n) if n else F.array().cast("array<string>"))


def point_scores(model: DataFrame, asked: DataFrame, order: int, method: str = "mle", gamma: float = 0.1) -> DataFrame:
    """Asked (context, word) with score and logscore (natural; minus infinity at 0), also where context or word are unseen."""
    total = model.groupBy("context").agg(F.sum("count").alias("total"))
    found = with_context(asked, order).join(model.select("context", "word", "count"), ["context", "word"], "left").join(total, "context", "left")
    c, n = F.coalesce("count", F.lit(0)), F.coalesce("total", F.lit(0))
    if method == "mle":
        score = F.when(n > 0, c / n).otherwise(0.0)
    else:
        g = {"laplace": 1.0, "lidstone": gamma}[method]
        found = found.crossJoin(F.broadcast(vocabulary_size(model)))
        score = (c + g) / (n + g * F.col("v"))
    return found.select("context", "word", score.alias("score")).withColumn("logscore", F.when(F.col("score") > 0, F.ln("score")).otherwise(float("-inf")))


def vocabulary_size(model: DataFrame) -> DataFrame:
    """V, the number of words, the end and the start mark. The condition reads the count, as the other parts of a query do."""
    return model.filter(F.col("count") > 0).agg((F.countDistinct("word") + 1).alias("v"))


def unigram_point_scores(words: DataFrame, asked: DataFrame, method: str, discount: float = 0.75, alpha: float = 0.4) -> DataFrame:
    """L7 - L9 of asked (sample), also of unseen ones."""
    t = words.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"))
    seen = unigram_scores(words, method, discount, alpha)
    n, v = F.col("n"), F.col("v")
    unseen = {"kneser_ney": (discount * v / n) / v, "witten_bell": 1.0 / (n + v), "stupid_backoff": alpha / (n + v)}[method]
    return asked.select("sample").join(seen, "sample", "left").crossJoin(F.broadcast(t)).select("sample", F.coalesce("score", unseen).alias("score"))


def generate(model: DataFrame, order: int, n: int, text_seed: list[str] | None = None, seed: int = 0) -> list[str]:
    """N words, each drawn by its count after the words before it, or of all words where the context is unseen. The draw is a
    top-1 over hashed exponential times, so the continuations stay where they are; n is the number of jobs."""
    out, said = [], list(text_seed or [])
    everything = model.groupBy("word").agg(F.sum("count").alias("count"))
    for i in range(n):
        context = (["<s>"] * (order - 1) + said)[len(said) :][: order - 1] if order > 1 else []
        own = model.filter(F.col("context") == F.array(*map(F.lit, context)).cast("array<string>"))
        u = (F.xxhash64("word", F.lit(seed), F.lit(i)) / F.lit(float(1 << 64)) + 0.5).cast("double")
        time = -F.ln(F.greatest(u, F.lit(1e-18))) / F.col("count")
        pick = own.orderBy(time, "word").select("word").first() or everything.orderBy(time, "word").select("word").first()
        if pick is None:
            break
        out.append(pick.word)
        said.append(pick.word)
    return out


def vocabulary(words: DataFrame, cutoff: int = 1) -> DataFrame:
    """L3 re-export: words that occur at least cutoff times."""
    return words.filter(F.col("count") >= cutoff).select("sample")


def looked_up(tokens: DataFrame, vocabulary_: DataFrame, token: str = "token", unknown: str = "<UNK>") -> DataFrame:
    """Tokens outside the vocabulary become the unknown mark."""
    known = vocabulary_.select(F.col("sample").alias(token), F.lit(True).alias("_known"))
    return tokens.join(known, token, "left").withColumn(token, F.when(F.col("_known"), F.col(token)).otherwise(unknown)).drop("_known")
