"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text, at most CHARS bytes of it. A text is parsed against each
automaton, from its start to its end, into the longest substrings that occur in the language's text; the language that
needs the fewest phrases, each weighed by the logarithm of the language's sample, wins.

All texts of a batch and all languages advance together, one table lookup a byte, in pieces of PIECE bytes. A piece is
first parsed as if a phrase began with it. As a greedy parse depends only on where a phrase begins, the parse of the piece
before is then carried on into it until one of its phrases begins where one of the piece's own does; from there on both
are the same. Where that does not happen within a piece, the text is parsed again in one run. So counts are those of the
whole text, whatever PIECE is.

Bounds of the sample: CHARS bytes a language, or fewer where so many languages are learned that their tables would exceed
MODEL_BYTES; whole distinct texts of up to PART bytes in the order of a hash, then longer ones, of which the last is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import keyed, real_id, slices, text_buffer

CHARS, PIECE = 32_000, 1024
#: Bytes of texts that the sample of a language takes first; bytes of all languages' tables.
PART, MODEL_BYTES = 2_000, 400_000_000
LETTER = regex.compile(r"\p{L}")


def folded() -> np.ndarray:
    """Byte to symbol: A-Z lowered; other ASCII but letters is one symbol, the space."""
    fold = np.arange(256)
    fold[:128] = 32
    fold[0x61:0x7B] = np.arange(0x61, 0x7B)
    fold[0x41:0x5B] = np.arange(0x61, 0x7B)
    return fold


def automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of text (symbol numbers): state by symbol, -1 where there is none."""
    n = 2 * len(text) + 2
    size, link = [0] * n, [-1] * n
    step = np.full((n, symbols), -1, np.int32)
    last, count = 0, 1
    for c in text.tolist():
        new, count = count, count + 1
        size[new] = size[last] + 1
        p = last
        while p >= 0 and step[p, c] < 0:
            step[p, c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = int(step[p, c])
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                clone, count = count, count + 1
                size[clone], link[clone] = size[p] + 1, link[q]
                step[clone] = step[q]
                while p >= 0 and step[p, c] == q:
                    step[p, c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step[:count]


class Model:
    """Automata of all languages in one table: the last symbol is padding, which stays at the root."""

    def __init__(self, texts: dict[str, bytes]):
        self.names = sorted(texts)
        fold = folded()
        seen = np.unique(np.concatenate([fold[np.frombuffer(t, np.uint8)] for t in texts.values()]))
        self.symbol = np.full(256, len(seen), np.int64)  # a symbol that no language has
        self.symbol[np.isin(fold, seen)] = np.searchsorted(seen, fold[np.isin(fold, seen)])
        self.width = len(seen) + 2
        tables, self.base, at = [], [], 0
        for n in self.names:
            t = automaton(self.symbol[np.frombuffer(texts[n], np.uint8)], self.width)
            t[:, -1] = 0
            t[t >= 0] += at
            tables.append(t)
            self.base.append(at)
            at += len(t)
        tables.append(np.full((1, self.width), -1, np.int32))  # after a symbol that a language lacks any symbol starts a phrase
        table = np.concatenate(tables)
        self.table, self.base = table.ravel() * np.int32(self.width), np.array(self.base, np.int64) * self.width  # states as offsets of their rows
        self.table[self.table < 0] = -1
        root = table[np.array(self.base) // self.width]
        self.root = np.where(root < 0, len(table) - 1, root) * self.width
        self.bits = np.log2(np.maximum(2, [len(texts[n]) for n in self.names]))

    def phrases(self, buf: np.ndarray, off: np.ndarray, piece: int | None = None) -> np.ndarray:
        """By text and language the number of phrases."""
        piece = piece or PIECE
        k, n = len(self.names), np.diff(off)
        pieces = -(-n // piece)
        doc = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = off[doc] + nth * piece
        size = np.minimum(piece, off[doc + 1] - start)
        symbols = self.symbol[buf]
        langs = np.arange(k)[:, None]
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        begin, length = start[order], size[order]
        live = np.searchsorted(-length, -np.arange(piece), "left")  # pieces longer than t
        state = np.repeat(self.base[:, None], len(doc), axis=1)
        count = np.zeros((k, len(doc)), np.int64)
        mark = np.zeros((k, len(buf)), bool)  # where phrases begin
        for t in range(int(length.max(initial=0))):
            m = live[t]
            at = begin[:m] + t
            c = symbols[at]
            to = self.table[state[:, :m] + c]
            end = to < 0 if t else np.ones((k, m), bool)
            mark[:, at] = end
            count[:, :m] += end
            state[:, :m] = np.where(to < 0, self.root[langs, c], to)
        out = np.zeros((len(n), k), np.int64)
        np.add.at(out, doc[order], count.T)
        # carry each piece's parse on into the next one: lanes of a language and a piece
        next_ = np.flatnonzero(nth > 0)
        lang, lane = np.repeat(np.arange(k), len(next_)), np.tile(next_, k)
        now = state[lang, rank[lane - 1]]
        more = np.zeros(len(lane), np.int64)  # phrases of the carried parse less those of the piece's own
        alone, t = [], 0
        while len(lane):
            over = t >= size[lane]
            if over.any():  # no common place: the whole text in one run
                alone.append(np.stack([doc[lane[over]], lang[over]]))
                lang, lane, now, more = (x[~over] for x in (lang, lane, now, more))
                if not len(lane):
                    break
            at = start[lane] + t
            c = symbols[at]
            to = self.table[now + c]
            end, own = to < 0, mark[lang, at]
            more += end.astype(np.int64) - own
            met = end & own
            np.add.at(out, (doc[lane[met]], lang[met]), more[met])
            now = np.where(end, self.root[lang, c], to)
            lang, lane, now, more = (x[~met] for x in (lang, lane, now, more))
            t += 1
        for d, j in set(zip(*np.concatenate(alone, axis=1).tolist())) if alone else ():
            out[d, j] = self.run(symbols[off[d] : off[d + 1]], j)
        return out

    def run(self, symbols: np.ndarray, j: int) -> int:
        """The number of phrases of one text against language j."""
        table, root, state, count = self.table, self.root[j], int(self.base[j]), 1
        for i, c in enumerate(symbols.tolist()):
            to = int(table[state + c])
            if to < 0:
                count += i > 0
                to = int(root[c])
            state = to
        return count

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the best language and its score: the share of 2**(-bits / 4) among all languages."""
        bits = self.phrases(buf, off) * self.bits
        least = bits.min(axis=1)
        return bits.argmin(axis=1), 1 / np.exp2(-(bits - least[:, None]) / 4).sum(axis=1)


def learn(docs: DataFrame, chars: int = CHARS) -> Model | None:
    """Of the labelled rows outside the held-out fifth, by language, distinct texts up to chars bytes (see the bounds above)."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(held != 0)
    slim = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"), F.crc32(F.col("text").cast("string")).alias("crc"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    distinct = slim.where("n > 0").groupBy("lang", "h", "n").agg(F.min(F.struct("id", "crc")).alias("o")).select("lang", "h", "n", "o.*")
    own = Window.partitionBy("lang").orderBy(F.col("n") > PART, "h", "id")
    first = distinct.withColumn("r", F.row_number().over(own)).where(F.col("r") <= chars // 16)  # a bound of rows, limited before the shuffle
    before = F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("b", F.coalesce(before, F.lit(0))).where(F.col("b") < chars).select("lang", "id", "crc", "b")
    texts = keyed(docs).join(F.broadcast(first), ["id", "crc"]).select("lang", "b", F.expr(f"substring(cast(text AS binary), 1, {int(chars)})").alias("t")).dropDuplicates(["lang", "b"])
    parts: dict[str, list] = {}
    for lang, b, t in texts.collect():  # languages by chars bytes, and what the last texts have beyond
        parts.setdefault(lang, []).append((b, bytes(t)))
    if not parts:
        return None
    fold = folded()
    width = len(np.unique(np.concatenate([fold[np.frombuffer(t, np.uint8)] for p in parts.values() for _, t in p]))) + 2
    most = min(chars, max(1, MODEL_BYTES // (8 * width * len(parts))))
    return Model({lang: b"\n".join(t for _, t in sorted(p))[:most] for lang, p in parts.items()})


def identified(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """For each row of docs: id, crc, lang_pred and score.

    `und` with score 0 if the text is null or has no letter, or if no row is labelled. Of languages that need equal bits the
    first by name wins. Rows that repeat get equal results; an empty table gives an empty result."""
    model = learn(docs, chars)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for b in batches:
            # marks of phrases take a byte for each language and byte of text
            for part in slices(b, "text", max(1 << 18, (16 << 20) // max(4, len(model.names) if model else 4))):
                buf, off = text_buffer(part.column(2))
                letter = np.fromiter((LETTER.search(t) is not None for t in part.column(2).to_pylist()), bool, len(part))
                best, score = model.predict(buf, off) if model else (np.zeros(len(part), int), np.zeros(len(part)))
                ok = letter & (model is not None)
                names = [model.names[k] if o else "und" for k, o in zip(best.tolist(), ok.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0))], ["id", "crc", "lang_pred", "score"])

    return keyed(docs).mapInArrow(run, "id long, crc long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    """op2: one row for each document."""
    held = F.coalesce(F.pmod(F.crc32(real_id().cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return identified(docs).select(real_id(), held.alias("held_out"), "lang_pred", "score")
