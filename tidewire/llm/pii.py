"""Problem 8: personal information in free text, by information-theoretic sanitisation.

Mentions with a form of their own (addresses of mail, telephone numbers,
identity numbers, street addresses) are found by form; they are the protected
entities. One pass over the whole corpus then measures how strongly other terms
reveal a person: a capitalised word followed by a rare capitalised word counts
as a given name when its occurrences stand near a protected entity far more
often than such words do by chance (pointwise mutual information over the
disclosure threshold) and are followed by many different words (entropy); a
pair of Chinese cue words counts when what stands
between them varies (entropy) and stands near protected entities; a word's own
information (its rarity) tells a surname from a common word. Spans whose terms
exceed the thresholds are names. In the sanitised text every mention is
replaced by its kind in brackets, which is the generalisation that stays
readable.

The learned terms are few whatever the corpus' size: each must make up a fixed
share of the documents, so there are at most (such words per document / share).

Defined results: null and empty texts give no mention and stay as they are;
overlapping forms count once (mail before identity before telephone before
address before name); positions count characters from 0; a given name alone
(a device or an operation) is no mention; an empty table gives an empty result;
further columns are not read. Whole texts are searched, of any length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.shared import written

#: Wide forms, odd blanks and dashes as their plain ones; every character stays one character.
SAME_LENGTH = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)} | {c: " " for c in map(ord, "\t             　")} | {c: "-" for c in map(ord, "‐‑‒–—−")}

AT = re.compile(r"@|[ ]?[(\[{][ ]?at[ ]?[)\]}][ ]?| at (?=[A-Za-z0-9-]+(?: dot |\.[a-z]))", re.I)
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'-")
DOT = r"(?:\.|[ ]?[(\[{][ ]?dot[ ]?[)\]}][ ]?| dot )"
DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*?{DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])(?:{DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-]))*", re.I)

IDENTITY = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # insurance
    r"|\d{6}-[A-Z]-\d{4}|\d{6}[-+]\d{3}[0-9A-Z](?![0-9])"  # personal codes by date of birth
    r"|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}"  # social security
    r"|\d{6} ?(?:19|20)\d{2}(?:0[1-9]|1[0-2])[0-3]\d ?\d{3}[0-9Xx]"  # resident identity
    r"|[A-Z]\d{8}|[A-Z]{2}\d{7}"  # passports
    r")(?![A-Za-z0-9]|-\d)"
)
PHONE = re.compile(
    r"(?<![A-Za-z0-9.@/+-])(?:"
    r"(?:\+|00[ .-]?)[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?(?:\(?\d{1,4}\)?[ .-]?){1,4}\d{2,4}"  # with a country
    r"|\(?0\d{1,4}\)?[ -]\d{3,4}[ -]?\d{3,6}(?:[ -]\d{3,4})?"  # with a trunk zero
    r"|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ ./-])\d{3}[ .-]\d{2}[ .-]?\d{2}"  # ten digits, North American
    r"|0\d{2,3}-?\d{7,8}|1[2-9]\d-\d{4}-\d{4}|1[2-9]\d \d{4} \d{4}|1[2-9]\d{9}"  # Chinese
    r")(?![A-Za-z0-9]|[.-]\d)"
)
ROAD = r"(?:Street|St|Road|Rd|Drive|Dr|Lane|Ln|Avenue|Ave|Terrace|Way|Court|Crescent|Close|Place|Square|Boulevard|Blvd|Gardens|Grove|Row|Hill|Walk|Mews|Parade)"
LETTERS = r"[A-Za-zÀ-ɏ'’-]*"
WORD = r"[A-Za-zÀ-ɏ]" + LETTERS
ADDRESS = re.compile(
    r"(?<![A-Za-z0-9/.-])(?:"
    r"(?:(?:[Ff]lat|[Uu]nit|[Aa]pt\.?|[Aa]partment|[Ss]uite|[Rr]oom) \d+[A-Za-z]?(?:, ?|/| ))?\d{1,5}[A-Za-z]?(?:"
    rf",? (?:rue|via|calle|chemin|place|avenue|boulevard) (?:(?:de|du|des|la|le|di|del) |d'|l')*{WORD}"
    rf"| (?:[A-ZÀ-Þ]{LETTERS} ){{1,3}}?{ROAD}(?![A-Za-z])| [a-zß-ÿ]{LETTERS} {ROAD.lower()}(?![A-Za-z]))"
    r")"
)
ADDRESS_DE = re.compile(rf"(?<![A-Za-z0-9/.-]){WORD}(?:straße|strasse|weg|allee|gasse|platz) \d{{1,4}}[a-z]?(?:, \d{{5}} {WORD})?")
#: What every number, and every Chinese address, contains; the patterns are tried only around these.
NUMBERS, HOUSE_ZH = re.compile(r"\d[\d ./()+-]{5,}"), re.compile(r"\d+号")
#: Characters by which a pattern can begin before what it contains, and go on after it.
BEFORE, AFTER, BEFORE_ZH = 4, 12, 40
HAN = r"[㐀-鿿]"
ADDRESS_ZH = re.compile(rf"(?:(?<=寄往)|(?<=住址为)|(?<=地址为)|(?<=地址:)|(?<=住在)|(?<=位于)){HAN}{{2,6}}?[市县区]{HAN}{{1,8}}?(?:大道|路|街|巷|弄|胡同)\d+号|{HAN}{{2}}市{HAN}{{1,6}}?(?:大道|路|街|巷|弄|胡同)\d+号")

CAP = r"[A-ZÀ-Þ][a-zß-ÿĀ-ɏ'’]+"
SURNAME = rf"{CAP}(?:-{CAP})*"
#: Without width, so that overlapping pairs are all seen.
PAIR = re.compile(rf"(?<![\w.@-])(?=({CAP}) (?:([A-Z])\. ?)?({SURNAME})(?![\w@]|-\w))")
INITIAL = re.compile(rf"(?<![\w.@-])(?:[A-Z]\. ?){{1,2}}({SURNAME})(?![\w@]|-\w)")
REVERSED = re.compile(rf"(?<![\w.@-])({SURNAME}), ({CAP})(?: [A-Z]\.)?(?![\w@]|-\w)")
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Doctor|Col|Colonel|Gen|General|Capt|Captain|Maj|Major|Sgt|Lt|Rev|Sir|Dame|Lord|Lady|Judge|Sen|Rep|Gov"
TITLED = re.compile(rf"(?<![\w.@-])(?:{TITLES})\.? +(?:(?:{CAP}|[A-Z]\.) (?:[A-Z]\. ?)?)?({SURNAME})(?![\w@]|-\w)")
TITLE_WORDS = frozenset(TITLES.split("|"))
TITLE_WORD = re.compile(rf"(?:{TITLES})\.? +")
CAPITALISED = re.compile(r"\b[A-ZÀ-Þ][a-zß-ÿĀ-ɏ'’]+")
#: Chinese cues around a name, fixed values; the corpus decides which of their pairs reveal one.
LEFT_ZH = ("由", "联系人：", "联系人:", "记者 ", "记者：", "记者", "读者", "显示，", "作者：", "作者 ", "编辑：", "编辑 ", "通讯员 ", "通讯员", "市民", "居民")
RIGHT_ZH = ("签收", "，电话", " 电话", " 邮箱", "，邮箱", "来信", "的证件", "的身份证", "先生", "女士", "教授", "博士", "表示", "报道", "）")
CUED = re.compile("({})({}{{2,4}}?)({})".format(*("|".join(re.escape(c.translate(SAME_LENGTH)) for c in cues) if isinstance(cues, tuple) else cues for cues in (LEFT_ZH, HAN, RIGHT_ZH))))

#: Characters within which an entity counts as near.
NEAR = 80
#: A term is learned only above this share of documents and this count.
SUPPORT, LEAST = 2e-5, 2
#: Above this share of documents a capitalised word is common, and no surname.
COMMON = 2e-3
#: Bits of mutual information with protected entities above which a term is held to reveal a person; bits of entropy of what a cue pair holds.
DISCLOSURE, VARIETY = 3.0, 2.0
#: Of a term seen a few times only, its entropy must come so near to the most it can have.
EVEN = 0.8

ENTITIES = frozenset(("email", "identity", "phone", "address"))

Span = tuple[int, int, str]


@lru_cache(1)
def same_length_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    table[list(SAME_LENGTH)] = [ord(c) if isinstance(c, str) else c for c in SAME_LENGTH.values()]
    return table


def same_lengths(texts: list[str]) -> list[str]:
    """The texts in plain forms; those that need it all at once, by a table."""
    odd = [i for i, t in enumerate(texts) if not t.isascii() or "\t" in t]
    out = list(texts)
    if odd:
        sizes = np.fromiter((len(texts[i]) for i in odd), np.int64, len(odd))
        codes = np.frombuffer("".join(texts[i] for i in odd).encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = same_length_table()[codes].tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(sizes).tolist()
        for i, a, b in zip(odd, [0, *ends], ends):
            out[i] = plain[a:b]
    return out


def same_length(text: str) -> str:
    return same_lengths([text])[0]


def local_part(t: str, end: int, least: int) -> int:
    """Where the part before an at sign begins, looked for back to ``least``; ``end`` where there is none."""
    if end <= least or t[end - 1] not in LOCAL_CHARACTERS or t[end - 1] in ".%'":
        return end
    a = end
    while a > least and t[a - 1] in LOCAL_CHARACTERS:
        a -= 1
    while a < end and not (t[a].isascii() and t[a].isalnum()):
        a += 1
    return a


def _mail(t: str) -> Iterator[tuple[int, int]]:
    after = 0
    for m in AT.finditer(t):
        a = local_part(t, m.start(), after)
        domain = DOMAIN.match(t, m.end()) if a < m.start() else None
        if domain:
            yield a, domain.end()
            after = domain.end()


def protected(t: str) -> list[Span]:
    """Mentions with a form of their own, without overlaps, by position."""
    taken: list[Span] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in taken)

    def add(kind: str, pattern: re.Pattern, spans: list[tuple[int, int]]) -> None:
        for a, b in spans:
            taken.extend((m.start(), m.end(), kind) for m in pattern.finditer(t, a, b) if free(m.start(), m.end()) and (kind != "phone" or 7 <= sum(c.isdigit() for c in m[0]) <= 15))

    if "@" in t or "at" in t or "AT" in t:
        taken += [(a, b, "email") for a, b in _mail(t)]
    numbers: list[tuple[int, int]] = []
    for m in NUMBERS.finditer(t):
        a, b = max(0, m.start() - BEFORE), m.end() + AFTER
        if numbers and a <= numbers[-1][1]:
            a = numbers.pop()[0]
        numbers.append((a, b))
    add("identity", IDENTITY, numbers)
    add("phone", PHONE, numbers)
    whole = [(0, len(t))]
    if any(x in t for x in ("straße", "strasse", "weg", "allee", "gasse", "platz")):
        add("address", ADDRESS_DE, whole)
    add("address", ADDRESS, whole)
    if "号" in t:
        add("address", ADDRESS_ZH, [(max(0, m.start() - BEFORE_ZH), m.end()) for m in HOUSE_ZH.finditer(t)])
    return sorted(taken)


def _near(spans: list[Span], starts: list[int], a: int, b: int) -> bool:
    i = bisect_left(starts, a)
    return any(0 <= k < len(spans) and spans[k][0] - b <= NEAR and a - spans[k][1] <= NEAR for k in (i - 1, i))


GATHERED = "doc_id long, same long, found array<struct<rule:string,a:int,b:int,term:string,other:string,near:boolean>>, word string, n long"
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("term", pa.string()), ("other", pa.string()), ("near", pa.bool_())]))


def candidates(t: str) -> list[tuple[str, int, int, str, str, bool]]:
    """Protected mentions (rule: their kind) and what may be names (rule: the form), in the order in which they are decided."""
    spans = protected(t)
    starts = [s[0] for s in spans]
    out = [(k, a, b, "", "", True) for a, b, k in spans]

    def add(rule: str, a: int, b: int, term: str, other: str) -> None:
        i = bisect_left(starts, b)
        if i and spans[i - 1][1] > a:
            return
        out.append((rule, a, b, term, other, _near(spans, starts, a, b)))

    for m in TITLED.finditer(t):
        add("titled", TITLE_WORD.match(t, m.start()).end(), m.end(), "", m[1])
    for m in PAIR.finditer(t):
        if m[3] not in TITLE_WORDS:
            add("pair", m.start(), m.end(3), m[1], m[3])
    for m in REVERSED.finditer(t):
        add("reversed", m.start(), m.end(), m[2], m[1])
    for m in INITIAL.finditer(t):
        add("initial", m.start(), m.end(), "", m[1])
    if not t.isascii():
        for m in CUED.finditer(t):
            add("cued", m.start(2), m.end(2), f"{m[1]}|{m[3]}", m[2])
    return out


#: Counted beside the words: characters of all texts, and of those near a protected entity.
ALL, CLOSE = "*all", "*near"


def near_length(found: list[tuple], n: int) -> int:
    """Characters of a text that stand near a protected entity."""
    total, end = 0, 0
    for a, b in sorted((max(0, x[1] - NEAR), min(n, x[2] + NEAR)) for x in found if x[0] in ENTITIES):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one pass over the texts: each document's candidates, and counts of capitalised words."""
    for b in batches:
        words, docs, at, found = Counter(), [], [], []
        for i, (doc, t) in enumerate(zip(b.column(0).to_pylist(), same_lengths(b.column(1).to_pylist()))):
            words.update(CAPITALISED.findall(t))
            words[ALL] += len(t)
            if c := candidates(t):
                words[CLOSE] += near_length(c, len(t))
                docs.append(doc)
                at.append(i)
                found.append([dict(zip(("rule", "a", "b", "term", "other", "near"), x)) for x in c])
        k, w = len(docs), len(words)
        same = b.column(2).take(pa.array(at, pa.int64())).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs + [None] * w, pa.int64()), pa.array(same + [None] * w, pa.int64()), pa.array(found + [None] * w, _FOUND), pa.array([None] * k + list(words), pa.string()), pa.array([None] * k + list(words.values()), pa.int64())],
            ["doc_id", "same", "found", "word", "n"],
        )


class Terms:
    """What the corpus revealed: common words, given names, cue pairs."""

    def __init__(self, common: set[str], given: set[str], cues: set[str]):
        self.common, self.given, self.cues = common, given, cues


def gather(docs: DataFrame) -> DataFrame:
    """All candidates of all documents, written once; everything after reads these few columns, not the texts."""
    return written(docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("same")).mapInArrow(_gathered, GATHERED), "candidates")


def learn(gathered: DataFrame, docs: int) -> Terms:
    """Statistics over all documents; only terms above their support leave the aggregation."""
    least = max(float(LEAST), SUPPORT * docs)
    each = gathered.where("found IS NOT NULL").select("same", F.explode("found").alias("c")).select("same", "c.*").where("rule IN ('pair', 'cued')")
    # A text counts once, however often it names a person and is republished.
    texts = each.groupBy("rule", "term", "other", "same").agg(F.max(F.col("near").cast("long")).alias("near"))
    stats = texts.groupBy("rule", "term", "other").agg(F.count("*").alias("n"), F.sum("near").alias("near"))
    counted = gathered.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    common = counted.where((F.col("n") >= max(20.0, COMMON * docs)) & ~F.col("word").isin(ALL, CLOSE)).select("word")
    chars = {r["word"]: r["n"] for r in counted.where(F.col("word").isin(ALL, CLOSE)).collect()}
    first = F.substring_index("other", "-", 1)
    pairs = stats.where("rule = 'pair'").where(~F.col("term").rlike(f"^(?:{TITLES})$")).join(common.select(F.col("word").alias("first")), first == F.col("first"), "left_anti")
    entropy = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    given = pairs.groupBy("term").agg(F.sum("n").alias("n"), F.sum("near").alias("near"), entropy.alias("entropy"))
    given = written(given, "given")
    total = stats.where("rule = 'pair'").agg(F.sum("n"), F.sum("near")).first()  # chance: all pairs of capitalised words
    # Or by the text that is near an entity, where names themselves are most of these pairs.
    base = min(((total[1] or 0) + 1) / ((total[0] or 0) + 2), (chars.get(CLOSE, 0) + 1) / (chars.get(ALL, 0) + 1))
    bits = F.log2(F.col("near") / F.col("n") / F.lit(base))
    given = given.where((F.col("n") >= least) & (F.col("entropy") >= F.least(F.lit(VARIETY), EVEN * F.log2("n"))) & (F.col("near") > 0)).where(bits >= DISCLOSURE)
    cue = stats.where("rule = 'cued'").groupBy("term").agg(F.sum("n").alias("n"), F.sum("near").alias("near"), entropy.alias("entropy"))
    cue = cue.where((F.col("n") >= least) & (F.col("near") * 2 >= F.col("n")) & (F.col("entropy") >= VARIETY))
    return Terms(*(set(df.toArrow().column(0).to_pylist()) for df in (common, given.select("term"), cue.select("term"))))


def decided(found: list[dict], terms: Terms) -> list[Span]:
    """The mentions among a document's candidates, without overlaps, by position."""
    taken: list[Span] = []
    for c in found:
        rule, a, b = c["rule"], c["a"], c["b"]
        if rule in ("pair", "reversed") and c["term"] not in terms.given or rule == "cued" and c["term"] not in terms.cues:
            continue
        if rule in ("pair", "reversed", "initial"):  # after a form of address a common word is a surname too
            if any(p in terms.common for p in c["other"].split("-")):
                continue
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, "name" if rule in ("titled", "pair", "reversed", "initial", "cued") else rule))
    return sorted(taken)


def _decide(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *s) for d, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in decided(f, terms)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "start_at", "end_at", "kind"])

    return run


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, start_at, end_at, kind of every mention in ``docs`` (doc_id, text)."""
    gathered = gather(docs)
    terms = learn(gathered, docs.count())
    return gathered.where("found IS NOT NULL").select("doc_id", "found").mapInArrow(_decide(terms), "doc_id long, start_at long, end_at long, kind string")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("long"), "text")


def found(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(documents(spark, sf)).select("doc_id", "kind", "start_at")


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            parts, at = [], 0
            for s in spans or []:
                parts += [text[at : s["start_at"]], f"[{s['kind'].upper()}]"]
                at = s["end_at"]
            out.append(text if text is None else "".join([*parts, text[at:]]))
        n = [len(s or []) for s in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64())], ["doc_id", "clean_text", "n_mentions"])


def redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text with typed placeholders in place of its mentions."""
    docs = documents(spark, sf)
    # A document's mentions are bounded by its text, so they make one array.
    spans = mentions(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "kind"))).alias("spans"))
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_replaced, "doc_id long, clean_text string, n_mentions long")
