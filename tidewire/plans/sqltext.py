"""Pieces of SQL (in DuckDB's dialect, whose patterns know no look-around) that several queries share."""

from __future__ import annotations

from tidewire.config import CATEGORIES, HISTORY_STOPWORDS, TITLE_ALIASES, TITLE_STOPWORDS

SPACE = r"[\s\p{Z}\x{85}]"


def quoted(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


ENTITIES = {"amp": "&", "AMP": "&", "lt": "<", "LT": "<", "gt": ">", "GT": ">", "quot": '"', "QUOT": '"', "apos": "''", "nbsp": "\u00a0", "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "middot": "·", "copy": "©"}
#: Names that count without a semicolon too.
BARE = ("amp", "AMP", "lt", "LT", "gt", "GT", "quot", "QUOT", "nbsp", "middot", "copy")


def clean(x: str) -> str:
    """Decoded once (numbers, and the names above), then without scripts, styles, tags, double blanks and the usual footer."""
    named = " ".join(f"WHEN starts_with(p, '{n};') THEN '{c}' || substr(p, {len(n) + 2})" for n, c in ENTITIES.items())
    bare = " ".join(f"WHEN starts_with(p, '{n}') THEN '{ENTITIES[n]}' || substr(p, {len(n) + 1})" for n in BARE)
    number = "WHEN regexp_matches(p, '^#[0-9]+') THEN chr(CAST(regexp_extract(p, '^#([0-9]+)', 1) AS INTEGER)) || regexp_replace(p, '^#[0-9]+;?', '')"
    decoded = f"array_to_string(list_transform(string_split(coalesce({x}, ''), '&'), lambda p, i: CASE WHEN i = 1 THEN p {number} {named} {bare} ELSE '&' || p END), '')"
    plain = f"regexp_replace({decoded}, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'g')"
    return f"regexp_replace({squeeze(f"regexp_replace({plain}, '<[^>]+>', ' ', 'g')")}, '(?i)\\s*The post .* appeared first on .*$', '')"


def clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN regexp_replace(left({x}, {n - 1}), '[ ,.;，。；]+$', '') || '…' ELSE {x} END"


def norm_title(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"


def title_tokens(x: str) -> str:
    alias = "CASE " + " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in TITLE_ALIASES.items()) + " ELSE t END"
    raw = f"list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9-]*|[\\x{{3400}}-\\x{{9fff}}]{{2,}}'), lambda t: lower(t))"
    return f"list_sort(list_distinct(list_transform(list_filter({raw}, lambda t: NOT list_contains({quoted(TITLE_STOPWORDS)}, t)), lambda t: {alias})))"


def acronyms(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9-]*'), lambda t: regexp_full_match(t, '[A-Z][A-Z0-9-]{{2,}}')), lambda t: lower(t))))"


def history_tokens(x: str) -> str:
    stop = quoted(HISTORY_STOPWORDS)
    latin = f"list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9-]{{2,}}|\\d+(?:\\.\\d+)?'), lambda t: NOT list_contains({stop}, t))"
    runs = f"list_filter(regexp_extract_all(lower({x}), '[\\x{{3400}}-\\x{{9fff}}]{{2,}}'), lambda t: NOT list_contains({stop}, t))"
    pairs = f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substring(r, CAST(i AS INTEGER), 2))))"
    return f"list_sort(list_distinct(list_concat(list_concat({latin}, list_filter({runs}, lambda r: length(r) <= 4)), {pairs})))"


def keyword(text: str, word: str) -> str:
    if any("㐀" <= ch <= "鿿" for ch in word):
        return f"contains({text}, '{word}')"
    plain = "".join("\\" + ch if ch in "[]().+*?-" else ch for ch in word)
    return f"regexp_matches({text}, '(^|[^a-z0-9]){plain}([^a-z0-9]|$)')"


def hits(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST({keyword(text, w)} AS INTEGER)" for w in words) + ")"


def weighted(text: str, words: dict[str, int]) -> str:
    return "(" + " + ".join(f"{n} * CAST({keyword(text, w)} AS INTEGER)" for w, n in words.items()) + ")"


def canonical_url(u: str) -> str:
    base = f"regexp_replace(regexp_replace(coalesce({u}, ''), '^{SPACE}+|{SPACE}+$', '', 'g'), '#.*$', '')"
    head = f"lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1))"
    rest = f"substring({base}, length({head}) + 1)"
    path = f"regexp_replace(regexp_replace(split_part({rest}, '?', 1), '/{{2,}}', '/', 'g'), '/$', '')"
    kept = f"list_filter(string_split(regexp_extract({rest}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|source|output)(=|$)'))"
    text = f"array_to_string(list_transform({kept}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
    return f"({head} || {path} || CASE WHEN {text} <> '' THEN '?' || {text} ELSE '' END)"


def domain(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


def category_key(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^{SPACE}+|{SPACE}+$', '', 'g'))"


def best_category(text: str, default: str) -> tuple[str, str]:
    """SQL of the winning category and of its score: three a hit, two for the default, ties by precedence."""
    scores = [(n, f"(3 * {hits(text, w)} + CASE WHEN {default} = '{n.lower()}' THEN 2 ELSE 0 END)") for n, (_, w) in CATEGORIES.items()]
    listed = "[" + ", ".join(s for _, s in scores) + "]"
    names = "[" + ", ".join(f"'{n}'" for n, _ in scores) + "]"
    return f"{names}[list_position({listed}, list_max({listed}))]", f"list_max({listed})"


def found_words(text: str, words: tuple[str, ...]) -> str:
    """The words that occur, in the order given, as a list."""
    return "list_filter([" + ", ".join(f"CASE WHEN {keyword(text, w)} THEN '{w}' END" for w in words) + "], lambda w: w IS NOT NULL)"


def longest(listed: str, n: int) -> str:
    """The ``n`` longest words of a list, ties in its order."""
    return f"list_transform(list_slice(list_sort(list_transform({listed}, lambda w, i: {{'n': -length(w), 'i': i, 'w': w}})), 1, {n}), lambda x: x.w)"


def prepared(now: str, hours: int = 24) -> str:
    """Articles as collected; a query of its own."""
    host = f"regexp_replace(lower({strip("coalesce(domain, '')")}), '^www\\.', '')"
    cleaned = f"SELECT article_row, {clean('title')} AS t, {clean('description')} AS d, {canonical_url('url')} AS url, {host} AS host, {squeeze("coalesce(source, '')")} AS source, category, published_at FROM articles"
    return f"""SELECT article_row, {clip('t', 300)} AS title, {clip('d', 900)} AS description, url, CASE WHEN host <> '' THEN host ELSE {domain('url')} END AS domain, source, category,
  coalesce(published_at, TIMESTAMP '{now}' - INTERVAL {hours} HOUR) AS ts, published_at IS NULL AS estimated FROM ({cleaned}) WHERE t <> ''"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
