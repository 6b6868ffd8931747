"""Tokens and embeddings (K1-K5).

The vocabulary is a corpus job (split, explode, count with map-side
combine). Tokenising joins each token to the vocabulary. Documents are
hash-partitioned by a key of id and text; exploding, lookup and regrouping
stay inside that partitioning for all words of a vocabulary under the broadcast
bound, and beyond it for the most frequent words (Zipf); only the others are
shuffled, to a salted join. The mean of vectors (K5) is sums by plain
aggregates, made in one pass over the token lists; a row's sums are shuffled,
not its tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesight.plans.joins import hot_from_counts, split_hot_join
from citesight.functions.columns import once
from citesight.plans.rowindex import pin, with_row_index
from citesight.session import shuffle_partitions

# fixed values: reserved ids
PAD, BOS, EOS, UNK = 0, 1, 2, 3
SPECIALS = ["<pad>", "<bos>", "<eos>", "<unk>"]
SPLIT_PATTERN = "[^\\p{L}\\p{N}]+"
#: Largest tables that are broadcast, by their counted bytes in memory.
BROADCAST_VOCAB_BYTES = 32 << 20
BROADCAST_VECTOR_BYTES = 64 << 20
BROADCAST_WORD_BYTES = 64 << 20
#: A word of share p of the corpus weighs ``a / (a + p)`` in the default encoder.
WORD_SMOOTHING = 1e-3
#: Rounds of power iteration for the component that the encoder takes out.
POWER_STEPS = 8
#: Bytes a hash-map entry takes besides its values.
ENTRY_BYTES = 48
#: Rows of one id and one list of tokens that a task gives out by itself.
SAME_ROWS = 10_000


def words(text) -> Column:
    """Lower-cased word tokens (letters and digits), empty strings removed."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), SPLIT_PATTERN), lambda w: w != "")


def build_vocab(df: DataFrame, text_col: str) -> DataFrame:
    """K1: (token, count, token_id) of every word; ids after the reserved ones, by count desc then token."""
    counts = (df.select(F.explode(_split_words(text_col)).alias("token")).where("token <> ''")
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    ix = with_row_index(counts, [F.col("count").desc(), F.col("token").asc()], "_i")
    return ix.select("token", "count", (F.col("_i") + len(SPECIALS)).alias("token_id"))


def row_key(id_col: str, text_col: str) -> Column:
    """Key of id and text: rows of one key have the same tokens, rows without an id too."""
    return F.concat_ws("|", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("-")),
                       F.md5(F.col(text_col).cast("binary")))


def tokenise(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, out: str | None = None,
             bos: int = BOS, eos: int = EOS, unk: int = UNK,
             broadcast_bytes: int = BROADCAST_VOCAB_BYTES) -> DataFrame:
    """K2: ``{col}_tokens`` = [bos] + ids + [eos]; unknown words get ``unk``; null text gives an empty
    list. Rows without an id, and rows that repeat one, keep their own tokens."""
    out = out or f"{text_col}_tokens"
    n = shuffle_partitions(df.sparkSession)
    # whether there is a text is noted before the exchange, so that the text itself goes to its tokens alone
    docs = df.withColumn("_key", F.unhex(F.md5(row_key(id_col, text_col).cast("binary")))).withColumn(
        "_none", F.col(text_col).isNull()).repartition(n, "_key")
    once = docs.where(F.col(text_col).isNotNull()).select("_key", text_col).dropDuplicates(["_key"])
    toks = once.select("_key", F.posexplode(_split_words(text_col)).alias("pos", "token")).where("token <> ''")
    v = vocab.select("token", "token_id")
    size = vocab.agg(F.sum(F.octet_length("token") + ENTRY_BYTES)).first()[0] or 0  # one number

    def found(part: DataFrame, name: str) -> DataFrame:
        return part.groupBy("_key").agg(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(unk)).cast("long").alias("tid"))).alias(name))
    lists = []  # each by key, so that the rows' left joins stay in their partitions
    if size <= broadcast_bytes:
        lists.append(found(toks.join(F.broadcast(v), "token", "left"), "_t"))
    elif "count" not in vocab.columns:
        lists.append(found(split_hot_join(toks, v, "token", how="left"), "_t"))
    else:
        times = F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))
        common, rare = _by_frequency(vocab.select("token", "token_id", times.alias("count")), broadcast_bytes)
        near = toks.join(F.broadcast(common.select("token", "token_id")), "token", "left")
        lists.append(found(near if rare is None else near.where("token_id IS NOT NULL"), "_t"))
        if rare is not None:
            far = split_hot_join(near.where("token_id IS NULL").select("_key", "pos", "token"), rare.select("token", "token_id"), "token",
                                 how="left", hot=hot_from_counts(rare, "token"))
            lists.append(found(far.repartition(n, "_key"), "_far"))
    res, none = docs, F.array().cast("array<struct<pos:int,tid:bigint>>")
    for ids in lists:
        res = res.join(ids, "_key", "left")
    met = F.concat(*[F.coalesce(c, none) for c in ("_t", "_far")[:len(lists)]])
    tokens = F.concat(F.array(F.lit(bos).cast("long")), F.transform(F.sort_array(met), lambda s: s["tid"]), F.array(F.lit(eos).cast("long")))
    return res.withColumn(out, F.when(F.col("_none"), F.array().cast("array<bigint>")).otherwise(tokens)).drop("_key", "_none", "_t", "_far")


def tokenise_with(df: DataFrame, text_col: str, tokenizer_factory: Callable, out: str | None = None) -> DataFrame:
    """K2 with a caller-supplied tokenizer: ``tokenizer_factory()`` returns ``str -> list[int]``;
    it is built once per task and applied to Arrow batches (null text -> empty list)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<bigint>")
    def tok_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer_factory()  # once per task, reused for every Arrow batch
        for b in batches:
            yield b.map(lambda t: [] if t is None else [int(x) for x in tok(str(t))])
    return df.withColumn(out or f"{text_col}_tokens", tok_udf(F.col(text_col)))


def assemble_text(df: DataFrame, cols: Sequence[str], out: str = "to_embed", bos: str = "<s>",
                  eos: str = "</s>") -> DataFrame:
    """K3: ``bos c1 eos bos c2 ... eos``; rows with a null input dropped."""
    return df.dropna(how="any", subset=list(cols)).withColumn(
        out, F.concat(F.lit(bos), F.concat_ws(eos + bos, *[F.col(c) for c in cols]), F.lit(eos)))


def _place_and_sign(word: Column, dim: int) -> tuple[Column, Column]:
    """A word's place among ``dim`` and its sign, both from its MD5; null for no word."""
    digest = F.md5(word.cast("binary"))
    return ((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).cast("int"),
            F.when(word.isNotNull(), F.when(F.substring(digest, 9, 1) < "8", 1.0).otherwise(-1.0)))


def _split_words(text: str) -> Column:
    """The pieces that ``words`` filters: empty ones stay, so that a text has at least one."""
    return F.split(F.lower(F.col(text)), SPLIT_PATTERN)


def _by_frequency(weights: DataFrame, most_bytes: int, size: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent words, by powers of two of their counts as far as ``most_bytes`` of memory hold them,
    and the others (none where all fit). ``size``: an entry's bytes, the word's and the map's by default."""
    power = F.floor(F.log2("count"))
    size = F.octet_length("token") + ENTRY_BYTES if size is None else size
    sizes = weights.groupBy(power.alias("b")).agg(F.sum(size).alias("bytes")).collect()  # a row per bit
    least, left = 64, most_bytes
    for b, size in sorted(sizes, reverse=True):
        if size > left:
            return weights.where(power >= least), weights.where(power < least)
        least, left = b, left - size
    return weights, None


def _word_sums(keyed: DataFrame, text_col: str, dim: int, weights: DataFrame | None = None,
               broadcast_bytes: int = BROADCAST_WORD_BYTES) -> DataFrame:
    """(_key, _n, p, s): per distinct text, with the number of its rows, the sum of its words' signs at
    each of ``dim`` places, times the words' weights if given (a word without one weighs 1).

    A weighted word's place and sign are worked out once, not for every occurrence. A text without words has
    one row without a place. The weights of the frequent words are broadcast, within the byte bound, and their
    occurrences stay in their text's partition; only the words that were not met there, once per text, go to
    the other weights, salted where they are frequent all the same.
    """
    texts = keyed.groupBy("_key").agg(F.first(text_col, ignorenulls=True).alias("_text"), F.count(F.lit(1)).alias("_n"))
    toks = texts.select("_key", "_n", F.explode_outer(_split_words("_text")).alias("w")).withColumn("w", F.nullif("w", F.lit("")))
    place, sign = _place_and_sign(F.col("w"), dim)
    if weights is None:
        return toks.select("_key", "_n", place.alias("p"), sign.alias("s")).groupBy("_key", "_n", "p").agg(F.sum("s").alias("s"))

    def known(part: DataFrame) -> DataFrame:
        return part.withColumnRenamed("token", "w").select("w", place.alias("_p"), (sign * F.col("weight")).alias("_s"))
    common, rare = _by_frequency(weights, broadcast_bytes)
    toks = toks.join(F.broadcast(known(common)), "w", "left")
    if rare is None:
        toks = toks.select("_key", "_n", F.coalesce("_p", place).alias("p"), F.coalesce("_s", sign).alias("s"))
        return toks.groupBy("_key", "_n", "p").agg(F.sum("s").alias("s"))
    met = pin(toks.groupBy("_key", "_n", F.col("_p").alias("p"), F.when(F.col("_p").isNull(), F.col("w")).alias("w")).agg(
        F.sum("_s").alias("s"), F.count(F.lit(1)).alias("_times")))
    others = split_hot_join(met.where("w IS NOT NULL").select("_key", "_n", "w", "_times"), known(rare), "w", "left",
                            hot=hot_from_counts(rare.withColumnRenamed("token", "w"), "w"))
    others = others.select("_key", "_n", F.coalesce("_p", place).alias("p"), (F.coalesce("_s", sign) * F.col("_times")).alias("s"))
    both = met.where("w IS NULL").select("_key", "_n", "p", "s").unionByName(others)
    return (both.repartition(shuffle_partitions(keyed.sparkSession), "_key")
            .groupBy("_key", "_n", "p").agg(F.sum("s").alias("s")))


def _text_vectors(keyed: DataFrame, text_col: str, dim: int, weights: DataFrame | None = None) -> DataFrame:
    """(_key, _n, v): per distinct text the sums of ``_word_sums`` as a vector of length 1, or of zeros where
    there is nothing to sum. Staged, as every user reads it more than once."""
    sums = _word_sums(keyed, text_col, dim) if weights is None else _word_sums(keyed, text_col, dim, weights)
    rows = sums.groupBy("_key", "_n").agg(
        F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "s"))).alias("m"),
        F.sqrt(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).alias("norm"))
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    # the map is built once per text, not per place
    unit = once(F.map_from_entries("m"), lambda m: F.transform(
        at, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)) / F.col("norm")))
    return pin(rows.select("_key", "_n", F.when(F.col("norm") > 1e-9, unit).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("v")))


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _dot(u: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with("v", F.lit(list(u)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def _attach(keyed: DataFrame, vectors: DataFrame, out: str) -> DataFrame:
    """Each row with its text's vector; texts held by many rows are salted."""
    met = split_hot_join(keyed, vectors.select("_key", out), "_key", "left", hot=hot_from_counts(vectors, "_key", "_n"))
    return met.drop("_key")


def embed_hashed(df: DataFrame, text_col: str, out: str | None = None, dim: int = 64) -> DataFrame:
    """K4 without a fitted model: signed feature hashing of the words into ``dim`` places, L2-normalised;
    built-in functions only. Each distinct text is worked out once. A null text, or one without words, has
    the zero vector.
    """
    out = out or f"{text_col}_embedding"
    keyed = df.withColumn("_key", _text_key(text_col))
    return _attach(keyed, _text_vectors(keyed, text_col, dim).withColumnRenamed("v", out), out)


@dataclass(frozen=True)
class TextEncoder:
    """A fitted encoder: ``weights`` (token, count, weight), and the unit vector ``component`` that the
    corpus' texts share most (all zeros for a corpus without words)."""

    weights: DataFrame
    component: list[float]

    @property
    def dim(self) -> int:
        return len(self.component)


def _word_weights(df: DataFrame, text_col: str, smoothing: float) -> DataFrame:
    counts = pin(df.select(F.explode(_split_words(text_col)).alias("token")).where("token <> ''")
                 .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count")).first()[0]  # one number
    share = F.col("count") / F.lit(total)
    return counts.select("token", "count", (F.lit(smoothing) / (F.lit(smoothing) + share)).alias("weight"))


def _first_component(rows: DataFrame, dim: int, steps: int) -> list[float]:
    u = [dim ** -0.5] * dim
    for _ in range(steps):
        # the product with u is worked out once per text, not per place
        along = once(F.col("_n") * _dot(u), lambda d: F.transform("v", lambda x: d * x))
        moments = rows.select(F.posexplode(along).alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"))
        got = dict(moments.collect())  # dim numbers
        norm = math.sqrt(math.fsum(x * x for x in got.values()))
        u = [got.get(i, 0.0) / norm if norm > 0 else 0.0 for i in range(dim)]
    return u


def _fit(keyed: DataFrame, text_col: str, dim: int, smoothing: float, steps: int) -> tuple[TextEncoder, DataFrame]:
    """The encoder, and the staged vectors of the texts that it was fitted on."""
    weights = _word_weights(keyed, text_col, smoothing)
    rows = _text_vectors(keyed, text_col, dim, weights)
    return TextEncoder(weights, _first_component(rows, dim, steps)), rows


def fit_encoder(df: DataFrame, text_col: str, dim: int = 64, smoothing: float = WORD_SMOOTHING,
                steps: int = POWER_STEPS) -> TextEncoder:
    """K4: fit the default encoder on a corpus: frequency-weighted word vectors and their first component.

    A word that makes up the share ``p`` of all words weighs ``smoothing / (smoothing + p)``. A text is the
    normalised weighted sum of its words' signed places. The component is ``steps`` rounds of power iteration
    on the second moments of all rows' vectors, from the all-equal unit vector: a round is one aggregate of
    ``dim`` sums over the staged vectors, and only these ``dim`` numbers reach the driver.
    """
    return _fit(df.select(text_col).withColumn("_key", _text_key(text_col)), text_col, dim, smoothing, steps)[0]


def embed_weighted(df: DataFrame, text_col: str, out: str | None = None, encoder: TextEncoder | None = None,
                   dim: int = 64) -> DataFrame:
    """K4 default: the text's frequency-weighted word vector without the corpus' first component, L2-normalised.

    ``encoder`` comes from ``fit_encoder``; without one it is fitted on ``df``, whose texts' vectors then serve
    the fit and the result. Words that the fitted corpus lacks weigh 1. A null text, one without words, and one
    that is nothing but the component has the zero vector. ``df`` is read up to three times: stage a costly one.
    """
    out = out or f"{text_col}_embedding"
    keyed = df.withColumn("_key", _text_key(text_col))
    if encoder is None:
        encoder, rows = _fit(keyed, text_col, dim, WORD_SMOOTHING, POWER_STEPS)
    else:
        rows = _text_vectors(keyed, text_col, encoder.dim, encoder.weights)
    u = F.lit(encoder.component)
    zero = F.array_repeat(F.lit(0.0), encoder.dim)
    # of a unit vector v the part across u is v - (v.u) u, of squared length 1 - (v.u)^2
    vec = once(_dot(encoder.component), lambda c: F.when(1 - c * c > 1e-9, once(F.sqrt(1 - c * c), lambda rest: F.zip_with(
        "v", u, lambda x, y: (x - c * y) / rest))).otherwise(zero))
    return _attach(keyed, rows.select("_key", "_n", vec.alias(out)), out)


def embed_batch(df: DataFrame, text_col: str, out: str | None = None, encoder_factory: Callable | None = None,
                dim: int = 64, batch_size: int = 256, encoder: TextEncoder | None = None) -> DataFrame:
    """K4: a fixed-width vector per text. Without a model of the caller's, ``embed_weighted``, fitted on ``df``
    or with the fitted ``encoder``; a model (``encoder_factory()`` returns ``texts -> vectors``) runs in Arrow
    batches, one per worker."""
    if encoder_factory is None:
        return embed_weighted(df, text_col, out, encoder, dim)
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    udf = predict_batch_udf(encoder_factory, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(out or f"{text_col}_embedding", udf(F.col(text_col)))


def mean_pool(tokens: DataFrame, id_col: str, tokens_col: str, vectors: DataFrame, dim: int,
              pad: int = PAD, vocab: DataFrame | None = None,
              broadcast_bytes: int = BROADCAST_VECTOR_BYTES,
              slot: Callable[[Column], Column] | None = None) -> DataFrame:
    """K5: masked mean of token vectors per row (pad excluded, denominator clamped at 1e-9:
    a row without real tokens gets the zero vector).

    A row's mean follows from its token list: rows that share an id or have none keep their own.

    ``vectors``: (token_id, vec array<float>), where ``slot`` is given by the number that it makes of a token's
    id: a table that many tokens share stays as small as it is. The mean is a plain sum per place, grouped by id
    and a digest of the list: a task adds up a row's tokens, and only the sums are exchanged. ``tokens`` is read
    once where the vectors are broadcast. Beyond the bound the most frequent tokens' vectors are, by the counts of
    ``vocab`` (token_id, count) or else counted, and ``tokens`` is read again: stage a costly one.
    """
    key = F.unhex(F.md5(F.array_join(tokens_col, ",", "-").cast("binary")))  # a null list has the key of null
    # each row has one entry without a token besides its tokens, by which it is counted
    entries = F.concat(F.array(F.lit(None).cast("long")), tokens_col)
    slot = slot or (lambda token: token)
    # the key in a select of its own: beside the generator it would be worked out for every entry
    t = tokens.select(F.col(id_col).alias("_id"), key.alias("_key"), entries.alias("_entries"))
    t = t.select("_id", "_key", F.posexplode_outer("_entries").alias("_at", "_token")).select(
        "_id", "_key", (F.coalesce("_at", F.lit(0)) == 0).cast("long").alias("_row"),
        F.when(F.col("_token") != pad, slot(F.col("_token"))).alias("token_id"))
    # a token whose vector is null has none; one of other length, or with null places, is refused
    odd = (F.size("vec") != dim) | F.exists("vec", lambda x: x.isNull())
    v = vectors.where("vec IS NOT NULL").select("token_id", F.when(odd, F.raise_error(F.lit(
        f"a vector has not {dim} numbers")).cast(vectors.schema["vec"].dataType)).otherwise(F.col("vec")).alias("vec"))
    width = dim * (4 if "float" in dict(vectors.dtypes)["vec"] else 8) + ENTRY_BYTES
    if vectors.count() * width <= broadcast_bytes:  # counted bytes
        met = t.join(F.broadcast(v), "token_id", "left").withColumn("_times", F.lit(1))
    else:
        met = _meet_many(t, v, vocab, slot, pad, width, broadcast_bytes)
    sums = pin(met.groupBy("_id", "_key").agg(F.sum("_row").alias("_rows"), F.sum(F.when(F.col("vec").isNotNull(), F.col("_times"))).alias("_n"), *[
        F.sum(F.get("vec", F.lit(i)).cast("double") * F.col("_times")).alias(f"_s{i}") for i in range(dim)]))  # read by both parts below
    zero = F.array_repeat(F.lit(0.0).cast("double"), dim)
    mean = F.when(F.col("_n") > 0, F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(dim)])).otherwise(zero)
    means = sums.select(F.col("_id").alias(id_col), mean.alias("mean_vec"), "_rows")

    def repeated(part: DataFrame, times: Column) -> DataFrame:
        return part.select("*", F.explode(F.sequence(F.lit(1), times)).alias("_nr"))
    few = repeated(means.where(F.col("_rows") <= SAME_ROWS), F.col("_rows"))
    # a list that one id, or none, has very often is given out by many tasks
    many = repeated(means.where(F.col("_rows") > SAME_ROWS), F.ceil(F.col("_rows") / SAME_ROWS)).withColumnRenamed("_nr", "_part")
    many = repeated(many.repartition(shuffle_partitions(tokens.sparkSession), "_part"),
                    F.least(F.lit(SAME_ROWS), F.col("_rows") - (F.col("_part") - 1) * SAME_ROWS))
    return few.select(id_col, "mean_vec").unionByName(many.select(id_col, "mean_vec"))


def _meet_many(t: DataFrame, v: DataFrame, vocab: DataFrame | None, slot: Callable[[Column], Column], pad: int, width: int,
               broadcast_bytes: int) -> DataFrame:
    """``mean_pool``'s entries with their vectors (and ``_times``) where these are not all broadcast: the frequent
    ones are; of the others a row's own go to the row, once each."""
    if vocab is None:
        counts = t.where("token_id IS NOT NULL").groupBy("token_id").agg(F.count(F.lit(1)).alias("count"))
    else:
        special = vocab.sparkSession.range(len(SPECIALS)).select(F.col("id").alias("token_id"), F.lit(1 << 40).alias("count"))
        counts = vocab.select("token_id", "count").unionByName(special).where(F.col("token_id") != pad)
        counts = counts.select(slot(F.col("token_id")).alias("token_id"), "count").groupBy("token_id").agg(F.sum("count").alias("count"))
    counted = pin(v.join(counts, "token_id", "left").withColumn("count", F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))))
    common, rare = _by_frequency(counted, broadcast_bytes, F.lit(width))
    near = t.join(F.broadcast(common.select("token_id", "vec")), "token_id", "left").withColumn("_times", F.lit(1).cast("long"))
    if rare is None:
        return near
    far = near.where("token_id IS NOT NULL AND vec IS NULL").groupBy("_id", "_key", "token_id").agg(F.count(F.lit(1)).alias("_times"))
    far = split_hot_join(far, rare.select("token_id", "vec"), "token_id", hot=hot_from_counts(rare, "token_id"))
    # a row's vectors are exchanged as they are: sums are twice as wide, and few tokens of a row would be in one
    far = far.repartition(shuffle_partitions(t.sparkSession), "_id", "_key")
    return near.unionByName(far.withColumn("_row", F.lit(0).cast("long")))
