"""Language of mixed text: scripts narrow the candidates, Viterbi labels the words.

Every word gets a score per language from the counts of its letters in threes and of itself; languages
that are never written in the word's script are set aside. The best sequence of labels pays a penalty
for each change, so single odd words do not split a passage while real changes of language do. The
language of a document is the one with most letters; its score is their share.

The tables are learned from at most ``MAX_PER_LANGUAGE`` documents of each language, drawn by hash.
Everything is labelled, whole: a long text is cut into runs of words, the best way through each run is
found for every pair of languages at its ends, and the runs are then linked.

Defined results: null text, and text without a letter, is ``und`` with score 0. Equal shares go to the
language that sorts first. With nothing to learn from, every text is ``und``. An empty table gives no
rows.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import binary_text, doc_crc, slices, table
from tallyloom.session import ship_package

MAX_PER_LANGUAGE = 2_000
TRIPLE_BITS, WORD_BITS = 16, 17
#: A word speaks against a language by so much at most; another script by more; a change costs so much.
FLOOR, OTHER_SCRIPT, SWITCH = 8.0, 30.0, 12.0
RUN = 64
UNKNOWN = "und"

#: Scripts with a number of their own; letters of all further scripts share one.
OWN_SCRIPTS = 60
#: Two syllabaries that one language mixes.
_ONE_SCRIPT = {"HIRAGANA": "KANA", "KATAKANA": "KANA", "BOPOMOFO": "CJK"}


@cache
def _script_table() -> np.ndarray:
    """Script of each code point that is a letter, minus the script of each mark that may follow one, else 0.

    The script is the word of the character's name that names most letters: FULLWIDTH LATIN SMALL LETTER A
    is Latin. The commonest scripts of the basic plane come first, in order of their letters.
    """
    names = {c: unicodedata.name(chr(c), "").split() for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"}
    letters = Counter(w[0] for c, w in names.items() if w and c < 0x10000 and unicodedata.category(chr(c))[0] == "L")
    numbers: dict[str, int] = {}
    for script, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0])):
        script = _ONE_SCRIPT.get(script, script)
        numbers.setdefault(script, min(len(numbers) + 1, OWN_SCRIPTS + 1))
    table = np.zeros(0x110000, dtype=np.int8)
    for c, words in names.items():
        script = max(words[:3], key=lambda w: letters[w], default="")
        number = numbers.get(_ONE_SCRIPT.get(script, script), OWN_SCRIPTS + 1)
        table[c] = number if unicodedata.category(chr(c))[0] == "L" else -number
    return table


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))


class Words:
    """The words of a batch of texts as arrays over their joined bytes."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8).astype(np.int64)
        lead = (data & 0xC0) != 0x80
        script = np.zeros(len(data), dtype=np.int64)
        upper = (data >= 65) & (data <= 90)
        data[upper] += 32
        codes = _script_table()
        script[(data >= 97) & (data <= 122)] = codes[97]
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            after = [data[np.minimum(wide + k, len(data) - 1)] & 0x3F for k in (1, 2, 3)]
            head = data[wide]
            point = np.select(
                [head < 0xE0, head < 0xF0],
                [(head & 0x1F) << 6 | after[0], (head & 0x0F) << 12 | after[0] << 6 | after[1]],
                (head & 0x07) << 18 | after[0] << 12 | after[1] << 6 | after[2],
            )
            script[wide] = codes[np.minimum(point, 0x10FFFF)]
            latin_upper = (point >= 0xC0) & (point <= 0xDE) & (point != 0xD7)
            data[wide[latin_upper] + 1] += 0x20
            # The bytes that follow belong to the letter.
            owner = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
            script = script[owner]
        letter = script > 0
        if (script < 0).any():  # marks belong to the word of a letter beside them, and are no word alone
            part = script != 0
            begins = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0))
            holds = np.add.reduceat(letter, begins) > 0
            lengths = np.diff(np.append(begins, len(part)))  # the text begins with a space, which is no part
            letter = part & np.append(np.zeros(begins[0], dtype=bool), np.repeat(holds, lengths))
            script = np.abs(script)
        edge = np.diff(letter.astype(np.int8), prepend=0)
        self.start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.stop = stop
        self.size = self.stop - self.start
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.text_start = 1 + np.concatenate(([0], np.cumsum(sizes)))
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        self.point = np.cumsum(lead)  # code points up to and with each byte
        if not len(self.start):
            return
        at = np.flatnonzero(letter)
        plain = np.where(letter, data, 32).astype(np.uint64)
        mixed = plain[at - 1] * _POWERS[1] + plain[at] * _POWERS[2] + plain[at + 1] * _POWERS[3]
        self.triple = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(7)).astype(np.int64) & ((1 << TRIPLE_BITS) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        place = np.arange(len(at)) - np.repeat(self.first, self.size)
        whole = np.add.reduceat(plain[at] * _POWERS[np.minimum(place, 63)], self.first)
        self.word = ((whole ^ (whole >> np.uint64(29))) >> np.uint64(5)).astype(np.int64) & ((1 << WORD_BITS) - 1)
        self.scripts = np.bitwise_or.reduceat(np.int64(1) << script[at], self.first)


def learn(rows: list[tuple[str, bytes]]) -> dict | None:
    """Tables of log probabilities per language, and the scripts each language is written in."""
    names = sorted({lang for lang, _ in rows})
    triples, words, scripts = [], [], []
    for name in names:
        w = Words([text for lang, text in rows if lang == name])
        if not len(w.start):
            triples.append(np.zeros(1 << TRIPLE_BITS)), words.append(np.zeros(1 << WORD_BITS)), scripts.append(0)
            continue
        triples.append(np.bincount(w.triple, minlength=1 << TRIPLE_BITS).astype(float))
        words.append(np.bincount(w.word, minlength=1 << WORD_BITS).astype(float))
        used = [np.mean(w.scripts >> k & 1) for k in range(OWN_SCRIPTS + 2)]
        scripts.append(sum(1 << k for k, share in enumerate(used) if share >= 0.001))
    if not names:
        return None

    def logs(counts: list[np.ndarray]) -> np.ndarray:
        stacked = np.stack(counts, axis=1) + 0.5
        return np.log(stacked / stacked.sum(axis=0)).astype(np.float32)

    return {"names": names, "triples": logs(triples), "words": logs(words), "scripts": np.array(scripts)}


def word_scores(model: dict, w: Words) -> np.ndarray:
    """Score of every word for every language; the best language of a word has 0."""
    score = np.add.reduceat(model["triples"][w.triple], w.first).astype(np.float64) + model["words"][w.word]
    score = np.maximum(score - score.max(axis=1, keepdims=True), -FLOOR)
    kinds, which = np.unique(w.scripts, return_inverse=True)
    fits = (kinds[:, None] & ~model["scripts"][None, :]) == 0
    fits |= ~fits.any(axis=1, keepdims=True)
    score[~fits[which]] = -OTHER_SCRIPT
    return score


def best_labels(score: np.ndarray, text: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of every word on the best way through each text, by runs of ``RUN`` words."""
    n, langs = score.shape
    begins = np.flatnonzero(np.diff(text, prepend=-1))
    counts = np.diff(np.append(begins, n))
    runs = -(-counts // RUN)
    first_run = np.concatenate(([0], np.cumsum(runs)))
    owner = np.repeat(np.arange(len(begins)), counts)
    offset = np.arange(n) - begins[owner]
    run_of, slot = first_run[owner] + offset // RUN, offset % RUN
    padded = np.zeros((first_run[-1], RUN, langs))
    padded[run_of, slot] = score
    change = switch * (1 - np.eye(langs))
    way = np.broadcast_to(-change, (first_run[-1], langs, langs)) + padded[:, 0, None, :]
    back = np.empty((RUN, first_run[-1], langs, langs), dtype=np.uint8)
    own = np.arange(langs, dtype=np.uint8)
    for t in range(1, RUN):
        top = way.argmax(axis=2)
        jump = np.take_along_axis(way, top[:, :, None], 2) - switch
        back[t] = np.where(jump > way, top[:, :, None].astype(np.uint8), own)
        way = np.maximum(way, jump) + padded[:, t, None, :]
    # Link the runs of each text; texts with many runs go on alone.
    value = np.zeros((len(begins), langs))
    entry = np.empty((first_run[-1], langs), dtype=np.uint8)
    by_length = np.argsort(-runs, kind="stable")
    longer = np.searchsorted(-runs[by_length], -np.arange(runs.max()), "left")
    for r in range(runs.max()):
        live = by_length[: longer[r]]
        through = value[live][:, :, None] + way[first_run[live] + r]
        entry[first_run[live] + r] = through.argmax(axis=1)
        value[live] = through.max(axis=1)
    end = np.empty(first_run[-1], dtype=np.int64)
    state = value.argmax(axis=1)
    for r in range(runs.max() - 1, -1, -1):
        live = by_length[: longer[r]]
        end[first_run[live] + r] = state[live]
        state[live] = entry[first_run[live] + r, state[live]]
    label = np.empty((first_run[-1], RUN), dtype=np.uint8)
    every = np.arange(first_run[-1])
    come, here = entry[every, end], end
    for t in range(RUN - 1, -1, -1):
        label[:, t] = here
        if t:
            here = back[t, every, come, here]
    return label[run_of, slot]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def label_texts(model: dict | None, texts: list[bytes]) -> list[tuple[str, float, list[dict]]]:
    """(language, share of its letters, spans of one language in code points) of each text."""
    out = [(UNKNOWN, 0.0, []) for _ in texts]
    w = Words(texts)
    if model is None or not len(w.start):
        return out
    names = model["names"]
    label = best_labels(word_scores(model, w), w.text)
    letters = np.bincount(w.text * len(names) + label, w.size, len(texts) * len(names)).reshape(-1, len(names))
    breaks = np.flatnonzero((np.diff(w.text, prepend=-1) != 0) | (np.diff(label.astype(int), prepend=-1) != 0))
    ends = np.append(breaks[1:], len(label)) - 1
    base = w.point[w.text_start[w.text[breaks]] - 1]
    starts, stops = w.point[w.start[breaks] - 1] - base, w.point[w.stop[ends] - 1] - base
    for text, a, b, lang in zip(w.text[breaks].tolist(), starts.tolist(), stops.tolist(), label[breaks].tolist()):
        out[text][2].append({"start": a, "end": b, "lang": names[lang]})
    for i in np.flatnonzero(letters.sum(axis=1)):
        best = int(letters[i].argmax())
        out[i] = (names[best], float(letters[i, best] / letters[i].sum()), out[i][2])
    return out


def _learn_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["_lang"], r["_text"]) for b in batches for r in b.to_pylist())
    model = learn(rows)
    if model:
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = pickle.loads(model.value) if model else None
        for batch in slices(batches, "_text", 1 << 20):
            lang, score, spans = zip(*label_texts(loaded, batch.column("_text").to_pylist()))
            columns = [batch.column("doc_id"), pa.array(lang), pa.array(score), pa.array(spans, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return run


def train(docs: DataFrame, trainable: Column, per_language: int = MAX_PER_LANGUAGE) -> bytes | None:
    """The tables, learned in one task from at most about ``per_language`` documents of each language."""
    ship_package(docs.sparkSession)
    usable = docs.filter(trainable & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 30) * min(1, per_language / n)))])
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < limits[F.col("lang")]
    sample = usable.filter(drawn).select(F.col("lang").alias("_lang"), binary_text().alias("_text"))
    found = sample.repartition(1).mapInArrow(_learn_task, "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def trainable() -> Column:
    """Documents with this remainder are held out."""
    return F.pmod(doc_crc(F.col("doc_id")), F.lit(5)) != 0


def identify(docs: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row; learns from rows that ``learn_from`` tells."""
    model = train(docs, trainable() if learn_from is None else learn_from)
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None  # of a fixed size per language
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), binary_text().alias("_text"))
    return source.mapInArrow(
        _label(shared), "doc_id bigint, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
    )


def op9(spark: SparkSession, directory: str) -> DataFrame:
    found = identify(table(spark, directory, "documents"))
    return found.select("doc_id", (~trainable()).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op9_language_spans": op9}
