"""The prefix trie of conversations that are rebuilt from a base conversation's head and their own suffix.

A sequence of turns has a fingerprint: its length and the sum of x(i) * B^i over its turns, modulo three primes. These pairs are a monoid: those of two
sequences give that of their concatenation. So running sums along the original conversations are all that is computed on turns; the fingerprint of
each prefix of a rebuilt conversation is put together from the base's head and a difference of two of the conversation's own sums,
shifted, and no rebuilt text exists anywhere. Prefixes with equal depth and fingerprint are a node. Equality is verified: all members must have come
from one parent node by one last turn, turns are told apart by the SHA-256 of role and text, and the stored turns of one digest must all
have the same role and text. By induction over the depth equal fingerprints are then equal sequences; else the job fails instead of merging.

Sums over subtrees need no walk: what a node adds counts for its smallest member at the node's depth and above, and a node's members are
all conversations below it. Running sums go by ranges of (conversation, turn), so a conversation may hold any share of the turns.
The ids that end at a node reach its hash as sorted pieces, streamed through one state.

Rows without a conv_id take no part. A null turn comes first; rows of equal turn are ordered by role, then by the digest of role and text, so rows that repeat count
each and in any order. Null roles and texts are empty; an empty text is a turn like others. A conversation left without turns is a member of the root. An empty
table has no nodes. Texts of any length are read as a whole. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.prefix import RANGE, ranged, running

from .common import stored
from .mixing import WORD

#: Primes below 2^31: products of two residues fit a long. A base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1977654935, 1812433253)
#: Digits of an exponent are of so many values; three digits reach 2^30 turns.
DIGIT = 1024
#: Ids that a piece of a node's ends holds.
PIECE = 4096
KEY = ["depth", "f0", "f1", "f2"]
DIGEST = [f"d{i}" for i in range(4)]


def constants(values: list[int]) -> Column:
    """A literal array; the optimizer folds the cast."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def power(k: int, exponent: Column) -> Column:
    """BASES[k] to the power of a non-negative column, modulo PRIMES[k]."""
    p, out = PRIMES[k], F.lit(1).cast("long")
    for digit in range(3):
        step = pow(BASES[k], DIGIT**digit, p)
        values = [1]
        for _ in range(DIGIT - 1):
            values.append(values[-1] * step % p)
        out = out * F.get(constants(values), (F.floor(exponent / DIGIT**digit) % DIGIT).cast("int")) % p
    return out


def unshift(k: int, places: Column) -> Column:
    """The inverse of BASES[k] to the power of a column that is 0, 1, 2, ... up to the longest head."""
    inverse = pow(BASES[k], -1, PRIMES[k])
    return F.get(constants([pow(inverse, i, PRIMES[k]) for i in range(DIGIT)]), places.cast("int"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, words and the four quarters of the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    body = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    quarters = [F.conv(F.substring(body, 1 + 16 * i, 16), 16, -10).cast("long").alias(d) for i, d in enumerate(DIGEST)]
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), *quarters)


def verified(turns: DataFrame) -> None:
    """Fails if two stored turns of one digest differ."""
    body = F.struct("role", "text")
    unlike = turns.groupBy(*DIGEST).agg(F.min(body).alias("low"), F.max(body).alias("high")).filter("low <> high")
    if not unlike.isEmpty():
        raise ValueError("different turns have the same digest")


def summed(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), words, digest, and the sums before each turn (b) and up to it (s) by prime."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), *map(F.col, DIGEST)]
    placed = running(ranged(turns.drop("text"), ["conv_id"], order, "turn-ranges"), ["conv_id"], order, {"pos": F.lit(1)}).withColumn("pos", F.col("pos").cast("long") + 1)
    terms = {f"y{k}": F.pmod(F.xxhash64(F.lit(k), *DIGEST), F.lit(p)) * power(k, F.col("pos")) % p for k, p in enumerate(PRIMES)}
    rows = stored(placed.select(RANGE, "conv_id", "pos", "words", *DIGEST).withColumns(terms), "turn-terms")
    sums = running(rows, ["conv_id"], ["pos"], {f"b{k}": F.col(f"y{k}") for k in range(3)})
    both = [c for k, p in enumerate(PRIMES) for c in ((F.col(f"b{k}") % p).alias(f"b{k}"), ((F.col(f"b{k}") + F.col(f"y{k}")) % p).alias(f"s{k}"))]
    return stored(sums.select("conv_id", "pos", "words", *DIGEST, *both), "turn-sums")


def rebuilt(sums: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """conv_id, depth, fingerprint, parent's fingerprint (p), last turn's digest and words, and whether the conversation ends there; for every prefix."""
    s = [f"s{k}" for k in range(3)]
    heads = sums.filter(F.col("pos") <= longest).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "words", *DIGEST, *s))).alias("turns"))  # `longest` turns at most
    own = [F.coalesce(F.max(F.when(F.col("pos") == head, F.col(f"s{k}"))), F.lit(0)).alias(f"own{k}") for k in range(3)]
    convs = sums.groupBy("conv_id").agg(F.max("pos").alias("n"), *own).withColumns({"h": head, "base": base})
    joined = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.coalesce(F.slice("turns", F.lit(1), F.col("h")), F.array().cast(heads.schema["turns"].dataType))
    convs = joined.withColumn("head", taken).withColumn("kept", F.size("head").cast("long"))
    last = {f"from{k}": F.when(F.col("kept") > 0, F.try_element_at("head", F.col("kept").cast("int"))[f"s{k}"]).otherwise(F.lit(0)) for k in range(3)}
    convs = stored(convs.withColumns(last).withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("turns", "base"), "rebuilt-heads")
    nothing = [F.lit(0).cast("long").alias(d) for d in DIGEST]
    zero = lambda name: [F.lit(0).cast("long").alias(f"{name}{k}") for k in range(3)]
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *zero("f"), *zero("p"), *nothing, F.lit(0).cast("long").alias("words"), (F.col("length") == 0).alias("ends"))
    each = convs.select("conv_id", "length", "head", F.posexplode("head").alias("i", "t"))
    parent = [F.when(F.col("i") > 0, F.get("head", F.col("i") - 1)[f"s{k}"]).otherwise(F.lit(0)).alias(f"p{k}") for k in range(3)]
    above = each.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), *[F.col("t")[f"s{k}"].alias(f"f{k}") for k in range(3)], *parent, *[F.col("t")[d].alias(d) for d in DIGEST], F.col("t")["words"].alias("words"), (F.col("i") + 1 == F.col("length")).alias("ends"))
    rows = sums.join(convs.select("conv_id", "h", "kept", "length", *[f"{c}{k}" for c in ("own", "from") for k in range(3)]), "conv_id").filter("pos > h")
    depth = F.col("pos") - F.col("h") + F.col("kept")
    joined_up = lambda c, k: (F.col(f"from{k}") + F.pmod(F.col(f"{c}{k}") - F.col(f"own{k}"), F.lit(PRIMES[k])) * unshift(k, F.col("h") - F.col("kept")) % PRIMES[k]) % PRIMES[k]
    below = rows.select("conv_id", depth.alias("depth"), *[joined_up("s", k).alias(f"f{k}") for k in range(3)], *[joined_up("b", k).alias(f"p{k}") for k in range(3)], *DIGEST, "words", (depth == F.col("length")).alias("ends"))
    return stored(root.unionByName(above).unionByName(below), "prefixes")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and conv_id: runs of up to PIECE ids of one node, as text."""
    schema = pa.schema([*((c, pa.int64()) for c in (*KEY, "first")), ("ids", pa.string())])
    for batch in batches:
        out, now, ids = [], None, []
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))):
            if key != now or len(ids) == PIECE:
                if ids:
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                now, ids = key, []
            ids.append(conv)
        if ids:
            out.append((*now, ids[0], ",".join(map(str, ids))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by node and first id: the hash of each node's ids, joined by commas. A task holds one state, not a node's ids."""
    schema = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])
    now, state = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if key != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, state.hexdigest()), schema)], schema=schema)


def ends_of(prefixes: DataFrame) -> DataFrame:
    """depth, fingerprint and the hash of the conv_ids that end there."""
    ids = prefixes.filter("ends").select(*KEY, "conv_id")
    runs = ids.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pieces, ", ".join(f"{c} long" for c in (*KEY, "first")) + ", ids string")
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string")


def trie(conversations: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    base, head: of a column conv_id, the conversation whose head it takes, and how many turns of it (`longest` at most).
    """
    turns = turns_of(conversations)
    verified(turns)
    prefixes = rebuilt(summed(turns), base, head, longest)
    same = [*[f"p{k}" for k in range(3)], *DIGEST]
    grouped = prefixes.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"other_{c}") for c in same])
    alike = reduce(Column.__and__, [F.col(c) == F.col(f"other_{c}") for c in same])
    checked = grouped.filter(F.when(alike, F.lit(True)).otherwise(F.raise_error(F.lit("different prefixes have the same fingerprint")).cast("boolean")))
    nodes = stored(checked.select(*KEY, "conv_id", "n_convs", "words", "p0", "p1", "p2", ((F.col("n_convs") - 1) * F.col("words")).alias("saves")), "trie-nodes")

    up = {"depth": F.col("depth") - 1} | {f"f{k}": F.col(f"p{k}") for k in range(3)}
    children = nodes.filter("depth > 0").withColumns(up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    before = running(ranged(nodes.select("conv_id", "saves", *KEY), ["conv_id"], ["depth"], "node-ranges"), ["conv_id"], ["depth"], {"saved_above": F.col("saves")}).select(*KEY, "saved_above")
    nodes = stored(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(before, KEY), "trie-children")
    # what each conversation adds as the smallest member of nodes
    adds = nodes.groupBy("conv_id").agg(F.sum("saves").alias("adds"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    below = prefixes.select("conv_id", *KEY).join(adds, "conv_id").groupBy(*KEY).agg(F.sum("adds").alias("adds"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("below"), *[F.col(f"f{k}").alias(f"p{k}") for k in range(3)])
    out = nodes.join(below, KEY).join(ends_of(prefixes), KEY, "left")
    out = out.withColumn("below", F.col("depth")).join(parents, ["below", "p0", "p1", "p2"], "left")
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("adds") - F.col("saved_above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
