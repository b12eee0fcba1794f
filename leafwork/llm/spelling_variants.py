"""Spelling variants: words of one edit apart, found by merging the light subtrees of their trie.

The trie of all words is a table of its edges, and a node is known by a hash of its prefix. Among the edges
below a node the one with most words is heavy, the others are light; a word's path has at most log2(words)
light edges, as each at least halves what is below. At a node, the light subtrees are merged small-to-large into the rest: with
their first character replaced by the heavy one, skipped, or preceded by the heavy one, or replaced by an
error mark under which light siblings meet each other. Where a merged path ends at a word's end, the
two words are one edit apart. Merging a path is one row for each light edge of a word, and terminals
coincide in an equi-join on the edited word, so n words give at most n log2 n rows and a join key has
no more rows than there are characters.

Every pair is found once. If two words differ by a replaced character, they part at one node, by two light
edges (they meet under the mark) or by a heavy and a light one (the light one's character is replaced). If
one has a character more, take the last place where it may stand: there they part, either the longer by a
light edge, and the character is skipped, or the shorter does by a light edge beside the heavy one.

Words are maximal runs of A-Z, a-z and U+00C0-U+00FF with A-Z lower-cased, counted over whole texts: each
slice of texts adds up its own first, so a common word reaches the shuffle once from a slice. ``slips`` can
plant known slips, a pure function of a row's id and word.

Edge cases: null and empty texts have no words; runs of any length are read whole; a null id counts as an
empty one; rows that repeat count each time; ties go to the smaller word by code point; an empty table gives
no rows; other columns are ignored. Words and prefixes are told apart by 64-bit hashes within a slice and in
the trie; pairs are equal strings.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, saved
from .textarrays import arrow_map, codepoints, mix, span_hashes, spans, text_slices, utf8

LEAST_CHARS, LEAST_COUNT = 5, 3
#: A word's form is at least so many times as frequent as the word.
FACTOR = 2
SLIP = 97
_U = np.uint64
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(65, 91), *range(97, 123)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Longer runs are few and get their checksums one by one.
_LONG = 64
#: Rounds of tasks that write a table.
WRITERS = 4
#: Bytes of words whose paths are laid out at once.
_PATH_BYTES = 200_000


def crc_table() -> np.ndarray:
    """What a checksum's low byte adds to the rest of it (CRC-32, reflected)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def checksums(data: np.ndarray, s: np.ndarray, e: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, going on from the checksum of what stands before it."""
    table, size = crc_table(), e - s + 1
    order = np.argsort(-size, kind="stable")
    start, size = s[order], size[order]
    state = ~before[order]
    for k in range(min(_LONG, int(size[0]) if len(size) else 0)):
        m = int(np.searchsorted(-size, -k, "left"))
        state[:m] = table[(state[:m] ^ data[start[:m] + k]) & 0xFF] ^ (state[:m] >> 8)
    out = np.empty(len(s), np.uint32)
    out[order] = ~state
    for i in order[: np.searchsorted(-size, -_LONG, "left")].tolist():
        out[i] = zlib.crc32(data[s[i] : e[i] + 1].tobytes(), int(before[i]))
    return out


def counted(batch: pa.RecordBatch, slip: int | None, least: int) -> pa.RecordBatch:
    """Words of a slice of texts (id, text) and how often each occurs."""
    data, at = utf8(batch.column(1))
    data = _LOW[data]
    two = data == 0xC3  # the first byte of U+00C0 to U+00FF and of nothing else
    inside = _IN_WORD[data] | two
    inside[1:] |= two[:-1]
    s, e = spans(data, at, inside)
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(two, out=run[1:])
    chars = e - s + 1 - (run[e + 1] - run[s])
    found: dict[str, int] = {}
    if slip:
        before = np.array([zlib.crc32(f"{x or ''}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
        h = checksums(data, s, e, before[np.searchsorted(at, s, "right") - 1])
        slips = h % slip == 0
        for i in np.flatnonzero(slips & (chars > least)).tolist():
            word, k = data[s[i] : e[i] + 1].tobytes().decode(), int(h[i]) % int(chars[i])
            word = word[:k] + word[k + 1 :]
            found[word] = found.get(word, 0) + 1
        s, e, chars = s[~slips], e[~slips], chars[~slips]
    s, e = s[chars >= least], e[chars >= least]
    key = span_hashes(data, s, e)
    order = np.argsort(key)
    edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    n, first = np.diff(np.append(edge, len(key))), order[edge]
    raw = data.tobytes()
    words = [raw[a : b + 1].decode() for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
    return pa.record_batch([pa.array([*words, *found], pa.string()), pa.array([*n.tolist(), *found.values()], pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Words and their number over all texts: word, n."""

    def run(batches):
        for b in text_slices(batches):
            yield counted(b, slip, least_chars)

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return arrow_map(own, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def prefixes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Along each word's path: the word, the depth, the hash of the prefix so far, the next code point (0 ends the word)."""
    points, at, _ = codepoints(words)
    size = np.diff(at)
    word = np.repeat(np.arange(len(words)), size + 1)
    start = np.cumsum(size + 1) - (size + 1)
    depth = np.arange(len(word)) - start[word]
    next_ = np.zeros(len(word), np.uint32)
    ends = start + size
    mask = np.ones(len(word), bool)
    mask[ends] = False
    next_[mask] = points
    power = np.full(int(size.max(initial=0)) + 1, _U(0x9E3779B97F4A7C15), np.uint64)
    power[0] = 1
    term = mix(next_.astype(np.uint64) * _U(0xD6E8FEB86659FD93)) * np.multiply.accumulate(power)[depth]
    run = np.cumsum(term) - term  # what stands before each place
    return word, depth, mix(run - run[start][word] + depth.astype(np.uint64)), next_


def named(words: DataFrame) -> DataFrame:
    """The words with a hash as id: id, word, n."""

    def run(batches):
        for b in text_slices(batches, "word", _PATH_BYTES):
            _, _, node, next_ = prefixes(b.column(0))
            yield pa.record_batch([pa.array(node[next_ == 0].view(np.int64)), b.column(0), b.column(1)], names=["id", "word", "n"])

    return arrow_map(words.select("word", "n"), run, "id long, word string, n long")


def paths(words: DataFrame) -> DataFrame:
    """The edges on each word's path, its end included: id, depth, parent, ch, node."""

    def run(batches):
        for b in text_slices(batches, "word", _PATH_BYTES):
            word, depth, parent, ch = prefixes(b.column(1))
            node = np.append(parent[1:], _U(0))
            node[ch == 0] = ~parent[ch == 0]
            own = b.column(0).to_numpy()[word]
            yield pa.record_batch([pa.array(own), pa.array(depth.astype(np.int32)), pa.array(parent.view(np.int64)), pa.array(ch.astype(np.int32)), pa.array(node.view(np.int64))], names=["id", "depth", "parent", "ch", "node"])

    return arrow_map(words.select("id", "word"), run, "id long, depth int, parent long, ch int, node long")


def joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by sorting: all tables here grow with the words, and one whose files are small may take many times their size where it is broadcast."""
    return left.join(right.hint("merge"), on, how)


def light_edges(words: DataFrame) -> DataFrame:
    """Light edges on the words' paths, with the character of the heavy edge beside each (0: the end): id, depth, heavy."""
    own = paths(words)
    edges = own.groupBy("parent", "node", "ch").agg(F.count("*").alias("size"))
    below = Window.partitionBy("parent").orderBy(F.desc("size"), "ch")
    light = edges.select("node", F.first("ch").over(below).alias("heavy"), F.row_number().over(below).alias("place")).where("place > 1")
    return joined(own.select("id", "depth", "node"), light.select("node", "heavy"), "node").select("id", "depth", "heavy")


def edits(words: DataFrame) -> DataFrame:
    """What merging light subtrees asks of each word: the edited words to look up, and the word under an error mark (null: none): word, n, to, mark."""
    own = joined(light_edges(words), words, "id").select(
        "word", "n", F.expr("left(word, depth)").alias("a"), F.expr("substring(word, depth + 1)").alias("b"), F.expr("substring(word, depth + 2)").alias("c"), F.expr("CASE WHEN heavy > 0 THEN chr(heavy) END").alias("h")
    )
    inner = F.col("b") != ""
    skipped = F.when(inner & ~F.col("c").startswith(F.left("b", F.lit(1))), F.concat("a", "c"))
    replaced = F.when(inner, F.concat("a", "h", "c"))
    grown = F.concat("a", "h", "b")
    return own.select("word", "n", F.filter(F.array(skipped, replaced, grown), lambda x: x.isNotNull()).alias("to"), F.when(inner, F.concat("a", F.lit("\0"), "c")).alias("mark"))


def near(words: DataFrame, asked: DataFrame) -> DataFrame:
    """For each word with words one edit apart: word, n_near, and the most frequent of them as best (minus n, word)."""
    met = joined(asked.select("word", "n", F.explode("to").alias("to")), words.select(F.col("word").alias("to"), F.col("n").alias("to_n")), "to")
    both = F.array(F.struct("word", F.col("to").alias("by"), F.col("to_n").alias("by_n")), F.struct(F.col("to").alias("word"), F.col("word").alias("by"), F.col("n").alias("by_n")))
    pairs = met.select(F.explode(both).alias("x")).select("x.word", F.lit(1).alias("times"), F.struct((-F.col("x.by_n")).alias("less"), F.col("x.by").alias("by")).alias("best"))
    # Under one mark there is at most one word for each character: two of them say all that is asked.
    marked = asked.where("mark is not null").groupBy("mark").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("word").alias("by")))).alias("all")).where("size(all) > 1")
    each = marked.select((F.size("all") - 1).alias("times"), F.col("all")[0].alias("one"), F.col("all")[1].alias("two"), F.explode("all.by").alias("word"))
    sisters = each.select("word", "times", F.when(F.col("word") == F.col("one.by"), F.col("two")).otherwise(F.col("one")).alias("best"))
    return pairs.unionByName(sisters).groupBy("word").agg(F.sum("times").alias("n_near"), F.min("best").alias("best"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of few files: as many tasks write as the cluster runs at a time, some times over, however many partitions were shuffled."""
    return saved(df.coalesce(WRITERS * df.sparkSession.sparkContext.defaultParallelism), name)


def roots(forms: DataFrame) -> DataFrame:
    """For each word with a form the last of the chain of forms: word, root. A chain is as short as a logarithm, pointers double each round."""
    to = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = kept(joined(to, on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(to)
        to = further
        if to.where("moved").isEmpty():
            return to.select("word", "root")


def group(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Variants and their forms, for words (word, n): word, form, root, n, n_near, form_n."""
    own = kept(named(words), "words")
    asked = kept(edits(own), "edits")
    close = joined(own.select("word", "n"), near(own, asked), "word", "left")
    takes = F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False))
    told = kept(close.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.by")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    dropped(asked, own)
    chains = roots(told.where("form is not null"))
    return joined(told, chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE tab(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
runs AS (SELECT id, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY id, w),
bytes AS (SELECT w, n, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END FOR x IN string_split(id || ':' || w, '')]) AS b FROM runs),
h AS (SELECT w, n, xor(list_reduce(b, lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8), 4294967295), 4294967295) AS h FROM bytes, crc),
said AS (SELECT CASE WHEN h % 97 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, word[1 : i] AS a, word[i + 2 :] AS c FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.a = y.a AND x.c = y.c AND x.word <> y.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = a || c UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = a || c),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS b FROM pairs GROUP BY word),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM told WHERE form IS NULL UNION ALL SELECT told.word, chain.root FROM told JOIN chain ON told.form = chain.word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM told JOIN chain USING (word)
"""
