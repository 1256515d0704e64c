"""Problem 3: texts cut off before their last sentence ends, in pure SQL.

Texts become words: numbers and capitalised names stand for their kind, Han
characters count as words, sentence ends as a mark. Over all texts every word
trigram is counted inside (a word follows) and at ends (a sentence or the text
ends). The last trigram of a text without a final stop is joined to these
counts first: frequent inside but almost never terminal means cut. What the
trigrams do not show cut, may still end in a word that is only the beginning
of a frequent word, or of the word with which a frequent trigram goes on
(capitalised ones as written, numbers where years stand), in a mark of the cut, or in markup, a character or a clause broken off. Where a
trigram is rare, its last pair and then its last word decide. A text's own last
trigram is not counted for itself. ``rule`` tells what decided.

Defined results: null, empty and blank texts are no case; tags, links, notes
and cut marks after a complete sentence make no case; equal texts are judged
equally; an empty table gives an empty result; only the columns named are
read, so further columns cannot clash. Whole texts are counted, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.capping import contributor_key
from tidewire.shared import written

#: A trigram seen this often has its own verdict; a word this often inside counts as a word whose beginning may be left.
ENOUGH, FREQUENT = 5, 50
#: The share of terminal occurrences below which a last trigram means cut.
TERMINAL = 0.05

MARKS = r"(?:(?:…|\.\.\.+|。。。+|\[\s*(?:…|\.\.\.)\s*\]|\[\+?\d+ chars\]|\((?:more|continued)\)|（(?:更多|未完|余下\d+字)）|(?i:continue reading|read more)|阅读全文|查看全文|展开全文)\s*)+$"

_WORDS = r"""
SELECT record_set, row_key, cut_markup, marked, stopped, open_end,
  CASE WHEN cut_markup OR NOT stopped THEN regexp_extract(body, '(\\p{{Lu}}[\\p{{L}}\\p{{M}}]*)[^\\p{{L}}\\p{{M}}\\p{{N}}]*$', 1) ELSE '' END AS last_name,
  regexp_extract_all(body, '(\\p{{Lu}}[\\p{{L}}\\p{{M}}]+)', 1) AS names,
  CASE WHEN han THEN trim(regexp_replace(regexp_replace(marked_up, '[^\\p{{L}}\\p{{M}}¶⌁⓪④Ⓧ]+|(?<=[\\x{{3400}}-\\x{{9FFF}}])|(?=[\\x{{3400}}-\\x{{9FFF}}])', ' '), ' +', ' '))
    ELSE trim(regexp_replace(marked_up, '[^\\p{{L}}\\p{{M}}¶⌁⓪④Ⓧ]+', ' ')) END AS words
FROM (SELECT *, body rlike '[\\x{{3400}}-\\x{{9FFF}}]' AS han,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      concat('¶ ¶ ', body),
      'https?://[^ ]+', ' ⌁ '),
      '[.!?。！？]+(?=[^\\p{{L}}\\p{{N}}]|$)|[。！？]', ' ¶ '),
      '(?<![0-9])[0-9]{{4}}(?![0-9])', ' ④ '),
      '[0-9]+(?:[.,][0-9]+)*', ' ⓪ '),
      '\\p{{Lu}}[\\p{{L}}\\p{{M}}]*', ' Ⓧ ') AS marked_up
FROM (
  SELECT *,
    shown rlike '[.!?。！？][\\s"”’」』)）\\]】\']*$' AS stopped,
    shown rlike '[,，、:：;；(（\\[“‘「『][\\s]*$' AS open_end,
    CASE WHEN contains(shown, '&') THEN regexp_replace(shown, '&(?:[a-zA-Z]+|#[0-9]+);', ' ') ELSE shown END AS body
  FROM (
    SELECT record_set, row_key, cut_markup, unmarked <> plain AS marked, CASE WHEN right(unmarked, 1) rlike '[\\s—–-]' THEN regexp_replace(unmarked, '[\\s—–-]+$', '') ELSE unmarked END AS shown
    FROM (
      -- A pattern for an end is tried at every place of a text, so each is asked for only where the last characters allow it.
      SELECT *,
        (contains(plain, '<') OR contains(plain, '&') OR contains(plain, '�')) AND plain rlike '(?:<[a-zA-Z/!][^<>]*|<|&(?:[a-zA-Z]{{1,8}}|#[0-9]{{0,6}})?|\\x{{FFFD}})$' AS cut_markup,
        CASE WHEN right(plain, 1) IN ('…', ']', ')', '）') OR right(plain, 3) IN ('...', '。。。') OR right(plain, 2) = '全文' OR lower(right(plain, 4)) = 'more' OR lower(right(plain, 7)) = 'reading' THEN regexp_replace(plain, '{marks}', '') ELSE plain END AS unmarked
      FROM (
        SELECT record_set, row_key, CASE WHEN left(plain, 1) rlike '(?U)\\s' OR right(plain, 1) rlike '(?U)\\s' THEN regexp_replace(plain, '(?U)^\\s+|\\s+$', '') ELSE plain END AS plain
        FROM (SELECT record_set, row_key, CASE WHEN contains(text, '<') THEN regexp_replace(text, '<[a-zA-Z/!][^<>]*>', ' ') ELSE text END AS plain FROM {texts} WHERE text IS NOT NULL)
      ) WHERE plain <> ''
    )
  )
))
"""

_COUNTED = r"""
SELECT tri, count_if(NOT ended) AS inside, count_if(ended) AS ends FROM (
  SELECT substring_index(g, ' ', 3) AS tri, substring_index(g, ' ', -1) = '¶' AS ended
  FROM (SELECT explode(regexp_extract_all(concat(words, ' ¶'), '(?=([^ ]+ [^ ]+ [^ ¶]+ [^ ]+))[^ ]+ ', 1)) AS g FROM {words})
) GROUP BY tri
"""

_LASTS = r"""
  SELECT record_set, row_key, cut_markup, open_end, marked, last_name, last3, substring_index(last3, ' ', -2) AS last2, substring_index(last3, ' ', -1) AS last1,
    concat(substring_index(last3, ' ', 2), ' ④') AS year3
  FROM (SELECT *, substring_index(words, ' ', -3) AS last3 FROM {words} WHERE cut_markup OR NOT stopped)
"""

_NAMES = r"""
SELECT name, count(*) AS n FROM (SELECT explode(names) AS name FROM {words}) GROUP BY name
"""

_JUDGED = r"""
WITH bis AS (
  SELECT substring_index(tri, ' ', -2) AS bi, sum(inside) AS inside, sum(ends) AS ends FROM {tris} GROUP BY 1
), unis AS (
  SELECT substring_index(bi, ' ', -1) AS uni, sum(inside) AS inside, sum(ends) AS ends FROM bis GROUP BY 1
), beginnings AS (
  SELECT left(uni, k) AS part, max(inside) AS of_inside FROM (
    SELECT uni, inside, explode(sequence(1, length(uni) - 1)) AS k FROM unis WHERE inside >= {often} AND length(uni) > 1
  ) GROUP BY 1
), trigram_beginnings AS (
  SELECT concat(substring_index(tri, ' ', 2), ' ', left(substring_index(tri, ' ', -1), k)) AS part, max(inside) AS of_inside FROM (
    SELECT tri, inside, explode(sequence(1, length(substring_index(tri, ' ', -1)) - 1)) AS k FROM {tris} WHERE inside >= {often} AND length(substring_index(tri, ' ', -1)) > 1
  ) GROUP BY 1
), name_beginnings AS (
  SELECT left(name, k) AS part, max(n) AS of_name FROM (SELECT name, n, explode(sequence(1, length(name) - 1)) AS k FROM {names} WHERE n >= {often} AND length(name) > 1) GROUP BY 1
), counted AS (
  SELECT l.*, greatest(0, coalesce(m.n, 1) - 1) AS as_name, coalesce(q.of_name, 0) AS of_name, coalesce(g.of_inside, 0) AS begun3,
    coalesce(t.inside, 0) AS i3, greatest(0, coalesce(t.ends, 1) - 1) AS e3, coalesce(b.inside, 0) AS i2, greatest(0, coalesce(b.ends, 1) - 1) AS e2,
    coalesce(u.inside, 0) AS i1, greatest(0, coalesce(u.ends, 1) - 1) AS e1, coalesce(y.inside + y.ends, 0) AS years, coalesce(p.of_inside, 0) AS begun
  FROM {lasts} l
  LEFT JOIN {tris} t ON l.last3 = t.tri LEFT JOIN bis b ON l.last2 = b.bi LEFT JOIN unis u ON l.last1 = u.uni
  LEFT JOIN {tris} y ON l.year3 = y.tri AND l.last1 = '⓪' LEFT JOIN beginnings p ON l.last1 = p.part
  LEFT JOIN trigram_beginnings g ON l.last3 = g.part LEFT JOIN {names} m ON l.last_name = m.name AND l.last1 = 'Ⓧ' LEFT JOIN name_beginnings q ON l.last_name = q.part AND l.last1 = 'Ⓧ'
)
SELECT record_set, row_key, verdict.cut AS cut, verdict.rule AS rule FROM (SELECT *,
  CASE
    WHEN last1 NOT IN ('¶', '⌁') AND i3 + e3 >= {enough} AND e3 / (i3 + e3) < {terminal} THEN struct(true AS cut, 'trigram' AS rule)
    WHEN cut_markup OR open_end OR (marked AND last1 <> '¶') THEN struct(true AS cut, 'form' AS rule)
    WHEN last1 = '¶' OR last1 = '⌁' THEN struct(false AS cut, 'form' AS rule)
    WHEN i1 < {enough} AND i1 + e1 < {terminal} * begun THEN struct(true AS cut, 'beginning' AS rule)
    WHEN i3 + e3 < {enough} AND i3 + e3 < {terminal} * begun3 AND e1 < greatest({enough}, {terminal} * (i1 + e1)) THEN struct(true AS cut, 'beginning' AS rule)
    WHEN as_name < {enough} AND as_name < {terminal} * of_name THEN struct(true AS cut, 'beginning' AS rule)
    WHEN i3 + e3 < {terminal} * years THEN struct(true AS cut, 'beginning' AS rule)
    WHEN i3 + e3 >= {enough} THEN struct(false AS cut, 'trigram' AS rule)
    WHEN i2 + e2 >= {enough} THEN struct(e2 / (i2 + e2) < {terminal} AS cut, 'pair' AS rule)
    ELSE struct(e1 / greatest(1, i1 + e1) < {terminal} AS cut, 'word' AS rule)
  END AS verdict
FROM counted)
"""


def in_words(texts: DataFrame) -> DataFrame:
    marks = MARKS.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")
    return texts.sparkSession.sql(_WORDS.replace("{marks}", marks), texts=texts)


def judged(texts: DataFrame) -> DataFrame:
    """``texts`` has record_set, row_key, text; one row for each text without a final stop, with the verdict ``cut`` and the ``rule`` that gave it."""
    spark = texts.sparkSession
    words = written(in_words(texts), "words")  # made once; counts and last trigrams read their columns of it
    # Counted once: the pairs' and words' counts are sums of the trigrams', far fewer than the words of the texts.
    tris, names = written(spark.sql(_COUNTED, words=words), "trigrams"), written(spark.sql(_NAMES, words=words), "names")
    lasts = written(spark.sql(_LASTS, words=words), "last-trigrams")
    return spark.sql(_JUDGED, lasts=lasts, tris=tris, names=names, enough=ENOUGH, often=FREQUENT, terminal=TERMINAL)


def record_texts(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/edition_items.parquet").select(F.lit("edition_items").alias("record_set"), F.col("item_row").alias("row_key"), F.col("summary").alias("text"))
    arts = spark.read.parquet(f"{sf}/articles.parquet").select(F.lit("articles").alias("record_set"), F.col("article_row").alias("row_key"), F.col("description").alias("text"))
    return items.union(arts)


def found(spark: SparkSession, sf: str) -> DataFrame:
    return judged(record_texts(spark, sf)).where("cut").select("record_set", "row_key")


def by_source(spark: SparkSession, sf: str) -> DataFrame:
    """For every set and source, as written but for case and blanks: its rows, its cut rows and their share."""
    items = spark.read.parquet(f"{sf}/edition_items.parquet").select(F.lit("edition_items").alias("record_set"), F.col("item_row").alias("row_key"), "source")
    arts = spark.read.parquet(f"{sf}/articles.parquet").select(F.lit("articles").alias("record_set"), F.col("article_row").alias("row_key"), "source")
    cut = found(spark, sf).withColumn("is_cut", F.lit(1))
    rows = items.union(arts).join(cut, ["record_set", "row_key"], "left")
    out = rows.groupBy("record_set", contributor_key(F.col("source")).alias("source")).agg(F.count("*").alias("n_rows"), F.count("is_cut").alias("n_cut"))
    return out.withColumn("cut_share", F.col("n_cut") / F.col("n_rows"))
