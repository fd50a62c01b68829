"""Filling containers of fixed capacity with documents: several context-size tiers, packed into one another."""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bases import col
from ..plans.session import broadcast_checked, cut, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before that vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Other spellings of the language codes, after lower-casing and cutting at a hyphen or underscore.
LANGUAGES = {"eng": "en", "english": "en", "ger": "de", "deu": "de", "german": "de", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr", "french": "fr"}

#: Classes of a container's work, by which steps are balanced.
CLASSES = 64


def language(c: Column | str) -> Column:
    """A language code as two letters: ``EN``, ``de-DE`` and ``spa`` are ``en``, ``de`` and ``es``; null stays null."""
    short = F.regexp_replace(F.lower(F.trim(col(c))), "[-_].*$", "")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), short), short)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str, text: str, *columns: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col, *columns, tokens``: the number of tokens of each whole text, 0 for null. One pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32())], names=[id_col, *columns, "tokens"])

    kept = docs.select(id_col, *columns, text)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(count, f"{kinds}, tokens int")


class Gaps:
    """Containers and the room left in them, by the size of the room."""

    def __init__(self) -> None:
        self.held: list[list[tuple[int, int, int, int]]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms: list[int] = []

    def open(self, c: int) -> None:
        room = self.room[c]
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append(c)

    def close(self, c: int) -> None:
        room = self.room[c]
        self.by_room[room].remove(c)
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[bisect_left(self.rooms, room)]

    def new(self, items: list[tuple[int, int, int, int]], capacity: int) -> None:
        self.held.append(list(items))
        self.room.append(capacity - sum(i[1] for i in items))
        self.open(len(self.held) - 1)

    def fill(self, item: tuple[int, int, int, int]) -> int | None:
        """Put the item into the smallest gap that holds it; the container of that gap."""
        at = bisect_left(self.rooms, item[1])
        if at == len(self.rooms):
            return None
        c = self.by_room[self.rooms[at]][-1]
        self.close(c)
        self.held[c].append(item)
        self.room[c] -= item[1]
        self.open(c)
        return c

    def take(self, c: int) -> None:
        """Take out what was put into the container last."""
        self.close(c)
        self.room[c] += self.held[c].pop()[1]
        self.open(c)


def pack_bucket(items: list[tuple[int, int, int, int]], capacity: int, tiers: int) -> list[list[tuple[int, int, int, int]]]:
    """The containers of one bucket's ``(tier, tokens, id, piece)``. Tier t's window is capacity / 2**t.

    From the longest tier down: a tier's items, largest first, fill the gaps of longer windows where one is large enough (the
    smallest such gap). What finds none is packed into windows of the tier's own size, and as many of these windows as fit
    side by side are a container, whose gaps are open to the shorter tiers alone. In the end the emptiest containers are
    given up where all their items find gaps in others, whatever the tier.
    """
    gaps = Gaps()
    for t in range(tiers):
        mine = sorted((i for i in items if i[0] == t), key=lambda i: (-i[1], i[2], i[3]))
        rest = [i for i in mine if gaps.fill(i) is None]
        windows, size = Gaps(), capacity >> t
        for item in rest:
            if windows.fill(item) is None:
                windows.new([item], size)
        for k in range(0, len(windows.held), 1 << t):
            gaps.new([i for w in windows.held[k : k + (1 << t)] for i in w], capacity)
    for c in sorted(range(len(gaps.held)), key=lambda c: -gaps.room[c]):
        gaps.close(c)
        moved = []
        for item in sorted(gaps.held[c], key=lambda i: -i[1]):
            if (to := gaps.fill(item)) is None:
                break
            moved.append(to)
        if len(moved) == len(gaps.held[c]):
            gaps.held[c] = []
        else:
            for to in reversed(moved):
                gaps.take(to)
            gaps.open(c)
    return [h for h in gaps.held if h]


def step_offsets(placed: DataFrame) -> DataFrame:
    """``spec, bucket, work, before, containers``: how many containers of the spec come before those of a bucket and class of
    work, from the heaviest class down, and how many it has in all. One row for a bucket and class, never a container."""
    counts = cut(placed.where("position = 0").groupBy("spec", "bucket", "work").agg(F.count(F.lit(1)).alias("n")))
    classes = counts.groupBy("spec", "work").agg(F.sum("n").alias("n"))
    heavier = Window.partitionBy("spec").orderBy(F.desc("work"))  # CLASSES + 1 rows a spec
    classes = classes.select("spec", "work", (F.sum("n").over(heavier) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("spec")).alias("containers"))
    along = Window.partitionBy("spec", "work").orderBy("bucket")
    inner = counts.withColumn("inner", F.sum("n").over(along) - F.col("n"))
    return inner.join(broadcast_checked(classes), ["spec", "work"]).select("spec", "bucket", "work", (F.col("base") + F.col("inner")).alias("before"), "containers")


def packed(items: DataFrame, specs: DataFrame, *, tiers: int = 4, bucket: int = 20_000, step: int = 16) -> DataFrame:
    """``spec, container, position, id, piece, from_token, tokens, tier, step``: items (``id, tokens, lang``) packed for each
    spec (``spec, capacity, lang``; null lang: all items).

    Hierarchical multi-length packing. An item goes to the shortest of ``tiers`` windows capacity, capacity/2, ... that
    holds it; one beyond the capacity, and only that, is split into full containers and a remainder, which is routed by its
    size. Items are spread by a hash of their id and place in the table (copies of one id part too) over buckets of about
    ``bucket`` items, so no task holds more, whatever the table's size, and each bucket is packed tier by tier as
    ``pack_bucket`` says. Steps are groups of ``step`` containers out of all buckets of a spec: containers, from the heaviest
    class of work (the sum of squared lengths, which attention costs) to the lightest, are dealt out to the steps and back,
    so that all steps of a spec cost about the same.

    Defined results: an item of no tokens takes a position and no room; a null id or token count and a null or not
    positive capacity leave the row out; an id that is repeated is several items; of equal items the smaller id comes
    first; an empty table gives no rows. More than 10,000 specs are refused.
    """
    specs = specs.where("spec IS NOT NULL AND capacity > 0").select("spec", F.col("capacity").cast("int").alias("capacity"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("*")).alias("for"))
    if specs.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 specs")
    sizes = items.where("id IS NOT NULL AND tokens IS NOT NULL").withColumn("place", F.monotonically_increasing_id())
    # an item is wanted by the specs of its language and by those of all
    named = sizes.withColumn("for", F.explode(F.filter(F.array(F.lit("*"), F.concat(F.lit("="), "lang")), lambda x: x.isNotNull())))
    wanted = named.join(F.broadcast(specs), "for")
    buckets = F.broadcast(wanted.groupBy("spec").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("buckets")))
    wanted = wanted.join(buckets, "spec").withColumn("bucket", F.pmod(F.xxhash64("id", "place"), F.col("buckets")).cast("int"))
    whole = (F.greatest(F.col("tokens") - 1, F.lit(0)) / F.col("capacity")).cast("int")
    pieces = wanted.withColumn("piece", F.explode(F.sequence(F.lit(0), whole))).withColumn("size", F.least(F.col("tokens") - F.col("piece") * F.col("capacity"), "capacity"))
    tier = F.least(F.lit(tiers - 1), F.floor(F.log2(F.col("capacity") / F.greatest("size", F.lit(1))) + 1e-9).cast("int"))
    routed = pieces.select("spec", "capacity", "bucket", "id", "piece", "size", tier.alias("tier"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        spec, capacity, b = pdf.spec.iloc[0], int(pdf.capacity.iloc[0]), int(pdf.bucket.iloc[0])
        seen: Counter = Counter()
        out = []
        for c, held in enumerate(pack_bucket(list(zip(pdf.tier.tolist(), pdf["size"].tolist(), pdf.id.tolist(), pdf.piece.tolist())), capacity, tiers)):
            work = -(-CLASSES * sum(i[1] ** 2 for i in held) // capacity**2)
            out += [(spec, b, (b << 32) + c, p, id_, piece, piece * capacity, size, t, work, seen[work]) for p, (t, size, id_, piece) in enumerate(held)]
            seen[work] += 1
        return pd.DataFrame(out, columns=["spec", "bucket", "container", "position", "id", "piece", "from_token", "tokens", "tier", "work", "nth"])

    kinds = f"spec {specs.schema['spec'].dataType.simpleString()}, bucket int, container bigint, position int, id bigint, piece int, from_token bigint, tokens int, tier int, work int, nth int"
    placed = cut(routed.groupBy("spec", "bucket").applyInPandas(pack, kinds))
    ranked = placed.join(broadcast_checked(cut(step_offsets(placed)), 200_000), ["spec", "bucket", "work"])
    rank, steps = F.col("before") + F.col("nth"), F.ceil(F.col("containers") / step)
    turn, at = F.floor(rank / steps), rank % steps
    return ranked.select("spec", "container", "position", "id", "piece", "from_token", "tokens", "tier", F.when(turn % 2 == 0, at).otherwise(steps - 1 - at).alias("step"))


def p7_pack(spark: SparkSession, sf_dir: str, *, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = cut(token_counts(table(spark, sf_dir, "documents").select("doc_id", language("lang").alias("lang"), "text"), "doc_id", "text", "lang", tokenizer=tokenizer))
    specs = table(spark, sf_dir, "pack_specs").select(F.col("spec_id").alias("spec"), F.col("capacity_tokens").alias("capacity"), language("only_lang").alias("lang"))
    return packed(sizes.withColumnRenamed("doc_id", "id"), specs).withColumnsRenamed({"spec": "spec_id", "id": "doc_id"})


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each spec the containers, the documents in them, the share of their room that is used, and how evenly the work of
    full steps is spread (the lightest as a share of the heaviest)."""
    placed = cut(p7_pack(spark, sf_dir))
    held = placed.groupBy("spec_id", "step", "container").agg(F.sum("tokens").alias("used"), F.sum(F.col("tokens").cast("bigint") * F.col("tokens")).alias("work"), F.count_if(F.col("piece") == 0).alias("docs"))
    steps = held.groupBy("spec_id", "step").agg(*(F.sum(c).alias(c) for c in ("used", "work", "docs")), F.count(F.lit(1)).alias("containers"))
    full = F.when(F.col("containers") == F.max("containers").over(Window.partitionBy("spec_id")), F.col("work"))
    specs = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens")
    sums = steps.withColumn("full", full).groupBy("spec_id").agg(*(F.sum(c).alias(c) for c in ("containers", "docs", "used")), F.round(F.min("full") / F.max("full"), 4).alias("balance"))
    return sums.join(specs, "spec_id").withColumn("filled", F.round(F.col("used") / (F.col("containers") * F.col("capacity_tokens")), 4))


QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
