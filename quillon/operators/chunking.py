"""Chunking strategies: each turns (id, text) rows into (id, k, chunk) rows; null or empty text gives no chunk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Least characters of a sentence and of a segment, and the overlap under which neighbours part.
SENTENCE, SEGMENT, PART = 45, 90, 0.08
#: Characters of a document chunk; of a user's chunk, passage, and longest passage; words of sentences that part.
DOCUMENT, USER_LEAST, PASSAGE, PASSAGE_MOST, USER_PART = 1200, 12, 340, 700, 0.12
#: Fixed value: bytes that a chunk's vector takes as a code with its overhead, at 8 bits and in full.
STORAGE = (48, 384, 1536)
#: Labels of the header's types, numbers and names.
TYPES, NUMBERS, NAMES = "प्रकार: ", "संख्या: ", "नाम: "


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more).where("text <> ''")


def sliding(docs: DataFrame, id_col: str, text_col: str, width: int = 200, stride: int = 120, tail: int = 60) -> DataFrame:
    """Windows of ``width`` characters (k is where one starts); a text that fits one is one, and a later tail under ``tail`` is none."""
    n = F.length("text")
    at = F.when(n <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(stride)))
    d = _texts(docs, id_col, text_col).withColumn("k", F.explode(at)).where((F.col("k") == 0) | (F.length("text") - F.col("k") >= tail))
    return d.select("id", "k", F.substring("text", F.col("k") + 1, F.lit(width)).alias("chunk"))


def whole(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _texts(docs, id_col, text_col).select("id", F.lit(0).alias("k"), F.col("text").alias("chunk"))


def by_sentence(docs: DataFrame, id_col: str, text_col: str, least: int = SENTENCE) -> DataFrame:
    """Sentences of ``least`` characters or more; k counts the short ones too."""
    return _texts(docs, id_col, text_col).select("id", F.posexplode(T.sentences("text")).alias("k", "chunk")).where(F.length("chunk") >= least)


def header(text: Column, types: Column) -> Column:
    """Up to three sorted types, eight numbers and eight names of a text; empty if it has none of them."""
    named = F.array_distinct(F.slice(F.regexp_extract_all(text, F.lit(T.K.LATIN_RUN), F.lit(0)), 1, 8))
    parts = [(TYPES, F.slice(F.array_sort(F.array_distinct(types)), 1, 3)), (NUMBERS, T.numeric_spans(text)), (NAMES, named)]
    return F.concat_ws(" | ", *[F.when(F.size(p) > 0, F.concat(F.lit(label), F.array_join(p, " "))) for label, p in parts])


def contextual(docs: DataFrame, id_col: str, text_col: str, types: Column) -> DataFrame:
    """The whole text behind its header."""
    d = _texts(docs, id_col, text_col, types.alias("types"))
    h = header(F.col("text"), F.col("types"))
    return d.select("id", "text", h.alias("h")).select("id", F.lit(0).alias("k"), F.when(F.col("h") != "", F.concat(F.lit("["), "h", F.lit("] "), "text")).otherwise(F.col("text")).alias("chunk"))


def by_topic(docs: DataFrame, id_col: str, text_col: str, least: int = SEGMENT, part: float = PART) -> DataFrame:
    """Segments between neighbouring sentences that share few words.

    A cut needs ``least`` characters before it. Fewer than three sentences, or fewer than two segments of ``least``
    characters, give nothing; k counts short segments too. A text is cut once into pieces that hold their white space; each
    piece is compared with the one before, one fold over lengths and likenesses finds the cuts, and segments are joined
    from pieces, so the work grows as the text's length.
    """
    d = _texts(docs, id_col, text_col)
    blank = r"^[\s]+"
    bare = lambda x, i: F.when(i == 0, x).otherwise(F.regexp_replace(x, blank, ""))
    words = lambda t: F.filter(F.array_distinct(F.split(t, r"\s+")), lambda w: w != "")
    # sentence: its piece's number, its length, its words
    listed = lambda pieces: F.filter(F.transform(pieces, lambda x, i: F.struct(i.alias("i"), F.length(bare(x, i)).alias("n"), words(bare(x, i)).alias("words"))), lambda x: x["n"] > 0)
    near = lambda ss: F.transform(ss, lambda x, i: F.struct(x["i"].alias("i"), x["n"].alias("n"), F.when(i > 0, T.jaccard(F.get(ss, i - 1)["words"], x["words"])).otherwise(1.0).alias("near")))
    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")

    def step(acc: Column, x: Column) -> Column:
        cut = (acc["s"] >= 0) & (acc["size"] >= least) & (x["near"] < part)
        begin = cut | (acc["s"] < 0)
        closed = F.array_append(acc["done"], F.struct(acc["s"].alias("s"), acc["e"].alias("e")))
        return F.struct(F.when(cut, closed).otherwise(acc["done"]).alias("done"), F.when(begin, x["i"]).otherwise(acc["s"]).alias("s"), x["i"].alias("e"), F.when(begin, x["n"]).otherwise(acc["size"] + x["n"]).alias("size"))

    start = F.struct(none.alias("done"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(0).alias("size"))
    groups = lambda ss: F.aggregate(near(ss), start, step, lambda acc: F.array_append(acc["done"], F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))
    text_of = lambda pieces, g: F.regexp_replace(F.array_join(F.slice(pieces, g["s"] + 1, g["e"] - g["s"] + 1), ""), r"^\s+|\s+$", "")
    empty = F.expr("cast(array() as array<struct<k: int, chunk: string>>)")
    cut = lambda pieces, gs: F.filter(F.transform(gs, lambda g, k: F.struct(k.alias("k"), text_of(pieces, g).alias("chunk"))), lambda c: F.length(c["chunk"]) >= least)
    kept = T.let(T.sentence_pieces("text"), lambda pieces: T.let(listed(pieces), lambda ss: F.when(F.size(ss) >= 3, T.let(groups(ss), lambda gs: cut(pieces, gs))).otherwise(empty)))
    return d.select("id", kept.alias("kept")).where(F.size("kept") >= 2).select("id", F.inline("kept"))


def by_document(groups: DataFrame, members: str, most: int = DOCUMENT) -> DataFrame:
    """(group's columns, k, parent, members, chunk): a group's passages joined until ``most`` characters would be passed.

    ``members`` is an array<struct<id, text>> in order; groups of fewer than two give nothing. The first member of a chunk is
    its parent. Lengths alone are folded; texts are joined once.
    """
    none = F.expr("cast(array() as array<struct<s: int, n: int>>)")
    start = F.struct(none.alias("done"), F.lit(0).alias("s"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        n = F.length(x["text"]).cast("long")
        cut = (acc["n"] > 0) & (acc["size"] + n > most)
        closed = F.array_append(acc["done"], F.struct(acc["s"].alias("s"), acc["n"].alias("n")))
        return F.struct(F.when(cut, closed).otherwise(acc["done"]).alias("done"), F.when(cut, acc["s"] + acc["n"]).otherwise(acc["s"]).alias("s"), F.when(cut, 1).otherwise(acc["n"] + 1).alias("n"), F.when(cut, n).otherwise(acc["size"] + n).alias("size"))

    runs = F.aggregate(members, start, step, lambda acc: F.array_append(acc["done"], F.struct(acc["s"].alias("s"), acc["n"].alias("n"))))
    part = F.slice(members, F.col("run.s") + 1, F.col("run.n"))
    x = groups.where(F.size(members) >= 2).select("*", F.posexplode(runs).alias("k", "run")).withColumn("part", part)
    kept = [c for c in groups.columns if c != members]
    return x.select(*kept, "k", F.get("part", F.lit(0))["id"].alias("parent"), F.transform("part", lambda m: m["id"]).alias("members"), F.array_join(F.transform("part", lambda m: m["text"]), " ").alias("chunk"))


def distinct_groups(groups: DataFrame, key: str, members: str) -> DataFrame:
    """Of groups with the same members, in whatever order, that with the smallest key."""
    same = F.array_join(F.transform(F.sort_array(members), lambda m: m.cast("string")), "\x1f")
    first = groups.groupBy(F.sha2(same, 256).alias("same")).agg(F.min(key).alias(key))
    return groups.join(first.select(key), key, "left_semi")


def user_chunks(passages: DataFrame, id_col: str, text_col: str, title: Column, heading: Column | None = None) -> DataFrame:
    """(id, strategy, k, chunk): a user's passages by the rules of user sources, pieces of 12 characters or more.

    Whole; sentences where there are several; windows of two sentences where there are more; the text behind title, heading,
    names and numbers; runs of two or more neighbouring sentences that share words.
    """
    distinct = lambda pattern: F.slice(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), T.strip)), 1, 8)
    d = passages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), T.strip(title).alias("title"), (heading if heading is not None else F.lit(None).cast("string")).alias("heading")).where("text <> ''")
    names, numbers = distinct(T.K.LATIN_RUN), distinct(T.K.NUMERIC)
    head = F.concat_ws(" | ", "title", "heading", *[F.when(F.size(x) > 0, F.array_join(x, " ")) for x in (names, numbers)])
    words = lambda t: F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\p{M}\s]", " "), r"\s+")), lambda w: F.length(w) > 2)
    piece = lambda name, k, text: F.struct(F.lit(name).alias("strategy"), k.cast("int").alias("k"), text.alias("chunk"))
    none = F.expr("cast(array() as array<struct<strategy: string, k: int, chunk: string>>)")

    def runs(ss: Column) -> Column:
        tagged = F.transform(ss, lambda s: words(s))
        near = lambda ws: F.transform(ws, lambda w, i: (i > 0) & (F.size(F.get(ws, i - 1)) > 0) & (F.size(w) > 0) & (T.jaccard(F.get(ws, i - 1), w) >= USER_PART))
        start = F.struct(F.expr("cast(array() as array<int>)").alias("at"), F.lit(0).alias("i"))
        cuts = lambda joins: F.aggregate(joins, start, lambda a, j: F.struct(F.when(j, a["at"]).otherwise(F.array_append(a["at"], a["i"])).alias("at"), (a["i"] + 1).alias("i")), lambda a: F.array_append(a["at"], a["i"]))
        groups = lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda s, g: F.struct(s.alias("s"), (F.get(at, g + 1) - s).alias("n")))
        made = lambda gs: F.transform(F.filter(gs, lambda g: g["n"] > 1), lambda g, k: piece("semantic", k, F.array_join(F.slice(ss, g["s"] + 1, g["n"]), " ")))
        return T.let(tagged, lambda ws: T.let(cuts(near(ws)), lambda at: made(groups(at))))

    def of(ss: Column) -> Column:
        n = F.size(ss)
        one = F.array(piece("whole", F.lit(0), F.col("text")), piece("contextual", F.lit(0), F.concat(F.col("head"), F.lit("\n"), F.col("text"))))
        sentences = F.when(n > 1, F.filter(F.transform(ss, lambda s, k: piece("sentence", k, s)), lambda x: F.length(x["chunk"]) >= SENTENCE)).otherwise(none)
        windows = F.when(n > 2, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: piece("sliding", k, F.concat_ws(" ", F.get(ss, k), F.get(ss, k + 1))))).otherwise(none)
        return F.concat(one, sentences, windows, F.when(n > 2, runs(ss)).otherwise(none))

    x = d.withColumn("head", head).select("id", F.inline(T.let(T.sentences("text"), of)))
    return x.select("id", "strategy", "k", T.strip("chunk").alias("chunk")).where(F.length("chunk") >= USER_LEAST)


def triples(passages: DataFrame, by: str, id_col: str, text_col: str) -> DataFrame:
    """(by, parent, chunk): runs of three neighbouring passages of a group, the last one two or three long."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    g = passages.where(F.col(text_col).isNotNull()).groupBy(by).agg(rows.alias("rows"))  # a source's passages
    x = g.select(by, "rows", F.explode(F.sequence(F.lit(1), F.size("rows"), F.lit(3))).alias("at")).withColumn("part", F.slice("rows", F.col("at"), F.lit(3))).where(F.size("part") > 1)
    return x.select(by, F.get("part", F.lit(0))["id"].alias("parent"), F.array_join(F.transform("part", lambda m: m["text"]), " ").alias("chunk"))


def hard_wrap(s: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last blank if that is past 60 % of them."""
    out, i = [], 0
    if len(s) <= most:
        return [s]
    while i < len(s):
        end = min(i + most, len(s))
        if end < len(s):
            blank = s.rfind(" ", i, end + 1)
            end = blank if blank > i + most * 0.6 else end
        out.append(s[i:end].strip())
        i = end
    return [x for x in out if x]


_MARKED, _NUMBERED, _SPLIT = re.compile(r"#{1,6}\s+(.{1,90})"), re.compile(r"\d+(\.\d+)*\s+\S"), re.compile(r"(?<=[।.!?])\s+")


def _heading(line: str) -> str | None:
    t = line.strip()
    if m := _MARKED.fullmatch(t):
        return m[1].strip()
    letters = "".join(c for c in t if c.isalpha())
    capitals = len(letters) >= 3 and letters == letters.upper() and any("A" <= c <= "Z" for c in letters)
    return t if t and len(t) <= 80 and t[-1] not in ".!?।" and (capitals or _NUMBERED.match(t)) else None


def passages_of(text: str | None, target: int = PASSAGE, most: int = PASSAGE_MOST) -> list[tuple[str, str | None]]:
    """(passage, heading above it) in order: paragraphs are packed to ``target`` characters, those over ``most`` are cut at sentences, those at blanks."""
    out: list[tuple[str, str | None]] = []
    heading, held = None, ""

    def close() -> None:
        nonlocal held
        if held.strip():
            out.append((held.strip(), heading))
        held = ""

    for block in re.split(r"\n{2,}", text or ""):
        if "\n" not in block and (found := _heading(block)):
            close()
            heading = found
            continue
        if not (para := block.strip()):
            continue
        if len(held) + len(para) + 1 <= target:
            held = f"{held}\n{para}" if held else para
            continue
        close()
        if len(para) <= most:
            out.append((para, heading))
            continue
        for sentence in filter(None, map(str.strip, _SPLIT.split(para))):
            for piece in hard_wrap(sentence, most):
                if len(held) + len(piece) + 1 > target:
                    close()
                held = f"{held} {piece}" if held else piece
        close()
    close()
    return out


def to_passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, text, heading): the passages of each text. State runs through a text's blocks, so Arrow batches go to Python."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [passages_of(t) for t in batch.column(1).to_pylist()]
            row = pa.array([i for i, ps in enumerate(cut) for _ in ps], pa.int64())
            k = pa.array([n for ps in cut for n in range(len(ps))], pa.int32())
            text, heading = (pa.array([p[i] for ps in cut for p in ps], pa.string()) for i in (0, 1))
            yield pa.record_batch([batch.column(0).take(row), k, text, heading], names=["id", "k", "text", "heading"])

    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, k int, text string, heading string")


def measures(chunks: DataFrame) -> DataFrame:
    """Chunks, chunks a text and mean characters of each strategy of (strategy, id, chunk) rows, and of all together."""
    agg = chunks.groupBy("strategy", "id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"))
    out = agg.rollup("strategy").agg(F.sum("n").alias("chunks"), F.count("*").alias("texts"), F.sum("chars").alias("chars"))
    return out.select(F.coalesce("strategy", F.lit("TOTAL")).alias("strategy"), "chunks", F.round(F.col("chunks") / F.col("texts"), 6).alias("a_text"), F.round(F.col("chars") / F.col("chunks"), 6).alias("mean_chars"))


def shares(measured: DataFrame, passages: int) -> DataFrame:
    """``measures`` with chunks a passage of the corpus, share of all chunks, and bytes by kind of vector."""
    total = F.max(F.when(F.col("strategy") == "TOTAL", F.col("chunks"))).over(Window.partitionBy())  # one row a strategy
    sizes = [(F.col("chunks") * n).alias(f"bytes_{n}") for n in STORAGE]
    return measured.select("strategy", "chunks", "mean_chars", F.round(F.col("chunks") / passages, 6).alias("a_passage"), F.round(F.col("chunks") / total, 6).alias("share"), *sizes)
