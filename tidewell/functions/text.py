"""Column expressions for titles, names, HTML and keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
#: HTML entities in the order in which they are replaced.
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&bull;", "•"), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&ccedil;", "ç"),
]
#: Tags that survive sanitising.
ALLOWED_TAGS = ["p", "br", "ul", "ol", "li", "strong", "b", "em", "i", "u", "h1", "h2", "h3", "h4", "h5", "h6", "a", "blockquote", "code", "pre", "hr", "span", "div", "table", "thead", "tbody", "tr", "td", "th"]
#: Tags that break a line.
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote"
#: Noise in titles: (pattern, whether every match goes or the first one only).
TITLE_NOISE = [
    (r"(?i)\s*[\-–—|/]\s*(remote|hybrid|on-?site|work from home)\b.*$", False),
    (r"(?i)\s*\((remote|hybrid|on-?site|work from home)[^)]*\)\s*", True),
    (r"(?i)\s*\((canada|ontario|toronto|ottawa|mississauga|vancouver|usa|us|multiple locations?)[^)]*\)\s*", True),
    (r"(?i)\s*[\-–—|]\s*(full[- ]?time|part[- ]?time|permanent|contract|temporary|casual)\b.*$", False),
    (r"(?i)\s*\((full[- ]?time|part[- ]?time|permanent|contract|temporary|casual|\d+\s*month[s]?)[^)]*\)\s*", True),
    (r"(?i)\s*[\-–—|]\s*(req(uisition)?\s*#?\s*\d+|job\s*id\s*:?\s*\d+|#\s*\d{3,})\s*$", False),
    (r"(?i)\s*\(\s*(req|job)\s*#?\s*[\w-]+\s*\)\s*", True),
    (r"\s*[\-–—|]\s*\d{4,}\s*$", False),
    (r"\s*\(\s*\d{4,}\s*\)\s*$", False),
    (r"(?i)\s*[\-–—|]\s*(new grad|university grad|campus)\b", False),
    (r"\s*\bF/H\b\s*", True),
    (r"\s*\(H/F\)\s*", True),
]
#: Canonical forms of words in titles.
TITLE_WORDS = [
    (r"(?i)\bcyber\s*-?\s*security\b", "Cybersecurity"), (r"(?i)\binformation\s+security\b", "Information Security"), (r"(?i)\binfosec\b", "Information Security"), (r"(?i)\bit\s+security\b", "IT Security"),
    (r"(?i)\bsoc\b", "SOC"), (r"(?i)\bsiem\b", "SIEM"), (r"(?i)\bgrc\b", "GRC"), (r"(?i)\biam\b", "IAM"), (r"(?i)\bpam\b", "PAM"), (r"(?i)\bdfir\b", "DFIR"), (r"(?i)\bappsec\b", "Application Security"), (r"(?i)\bdevsecops\b", "DevSecOps"),
    (r"(?i)\bsr\.?\b", "Senior"), (r"(?i)\bjr\.?\b", "Junior"), (r"(?i)\bmgr\.?\b", "Manager"), (r"(?i)\beng\.?\b", "Engineer"), (r"(?i)\banalyste?\b", "Analyst"),
]
SMALL_WORDS = ["and", "or", "of", "the", "for", "to", "in", "on", "at", "a", "an", "with", "de", "du"]
SENIORITY_WORDS = "senior|junior|lead|principal|staff|intermediate|associate"
COMPANY_SUFFIXES = "inc|llc|ltd|limited|corp|corporation|co|company|group|holdings?|technologies|technology|solutions|services|canada|international|global|plc|gmbh|sa|nv|llp|lp|ulc|srl|pte|bv|ag"
STOP_WORDS = [
    "the", "and", "for", "with", "you", "our", "are", "will", "that", "this", "have", "from", "your", "all", "not", "can", "has", "been", "they", "their", "who", "what", "when", "work", "team", "role", "job",
    "about", "more", "other", "than", "into", "also", "were", "each", "such", "any", "may", "per", "out",
]
#: Letters with marks and their base letters.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz")
#: What counts as white space: the ASCII ones, the no-break space and the Unicode spaces.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def let(x: Column, f) -> Column:
    """f of x, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def squeezed(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def first_replaced(x: Column, pattern: str, by: str) -> Column:
    """Replaces the first match only."""
    flags, bare = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    return F.regexp_replace(x, f"{flags}^(.*?)(?:{bare})", f"$1{by}")


def _code_point(digits: Column, base: int) -> Column:
    n = F.conv(digits, base, 10).cast("bigint")
    return F.when((F.length(digits) < 9) & (n > 0) & (n < 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")


def decode_entities(x: Column) -> Column:
    """Named entities in table order, then decimal and hexadecimal ones; numbers out of range vanish."""
    out = reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), ENTITIES, x)
    for pattern, base in ((r"&#(\d+);", 10), (r"(?i)&#x([0-9a-f]+);", 16)):
        found = F.array_distinct(F.regexp_extract_all(out, F.lit(pattern), F.lit(0)))
        start = 3 if base == 10 else 4
        out = F.when(F.rlike(out, F.lit(pattern)), F.aggregate(found, out, lambda s, m: F.replace(s, m, _code_point(F.substr(m, F.lit(start), F.length(m) - start), base)))).otherwise(out)  # noqa: B023
    return out


def decode_escaped_html(x: Column) -> Column:
    """One layer of entities is decoded if escaped tags outnumber real ones."""
    escaped, real = F.regexp_count(x, F.lit(r"&lt;/?[a-zA-Z]")), F.regexp_count(x, F.lit(r"</?[a-zA-Z]"))
    return F.when((escaped > 0) & (escaped > real), decode_entities(x)).otherwise(x)


def html_to_text(x: Column) -> Column:
    """Readable text: scripts and styles go, list items get bullets, blocks get lines, entities are decoded, white space is tidied."""
    steps = [(r"(?i)<script[\s\S]*?</script>", " "), (r"(?i)<style[\s\S]*?</style>", " "), (r"(?i)<li\b[^>]*>", "\n• "), (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n"), (r"<[^>]+>", " ")]
    bare = decode_entities(reduce(lambda s, e: F.regexp_replace(s, *e), steps, F.coalesce(x, F.lit(""))))
    tidy = stripped(F.regexp_replace(F.regexp_replace(bare, r"[ \t\u00A0]+", " "), r"\n{3,}", "\n\n"))
    return F.array_join(F.transform(F.split(tidy, "\n", -1), stripped), "\n")


#: A tag from its beginning to the end of a piece that a closing bracket ended.
_TAG = r"(?s)</?[a-zA-Z][a-zA-Z0-9]*(?![A-Za-z0-9_]).*$"
_HREF = rf"""(?is)href{SPACE}*={SPACE}*(?:"([^"]*)"|'([^']*)'|((?:(?!{SPACE})[^>])+))"""


def _safe_tag(tag: Column) -> Column:
    """An allowed tag in lower case without attributes, a link with its http(s) target; nothing for any other tag."""

    def link(attributes: Column) -> Column:
        target = stripped(F.concat(*(F.regexp_extract(attributes, _HREF, i) for i in (1, 2, 3))))
        opened = lambda u: F.concat(F.lit('<a href="'), F.replace(u, F.lit('"'), F.lit("&quot;")), F.lit('" target="_blank" rel="nofollow noopener noreferrer">'))
        return let(target, lambda u: F.when(F.rlike(u, F.lit("(?i)^https?://")), opened(u)).otherwise("<a>"))

    def shown(name: Column) -> Column:
        return (
            F.when(~name.isin(ALLOWED_TAGS), "")
            .when(F.startswith(tag, F.lit("</")), F.concat(F.lit("</"), name, F.lit(">")))
            .when(name == "a", link(F.substr(tag, F.lit(3))))
            .otherwise(F.concat(F.lit("<"), name, F.lit(">")))
        )

    return let(F.lower(F.regexp_extract(tag, "^</?([a-zA-Z0-9]+)", 1)), shown)


def sanitize_html(x: Column) -> Column:
    """Allowed tags without attributes; of links only http(s) targets stay.

    Comments, scripts, styles, frames and embedded objects go first. What is left is cut once at closing brackets: a piece's tag is what begins
    at its first tag name, so all tags are read in one pass over the text, and each is looked up in the list of allowed ones. Null is empty.
    """
    drop = [r"<!--[\s\S]*?-->", r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"(?i)<iframe[\s\S]*?</iframe>", r"(?i)<(?:object|embed|form|input|button|link|meta|base)(?![A-Za-z0-9_])[^>]*>"]
    pieces = F.split(reduce(lambda s, p: F.regexp_replace(s, p, ""), drop, F.coalesce(x, F.lit(""))), ">", -1)

    def safe(piece: Column) -> Column:
        kept = lambda tag: F.when(tag == "", F.concat(piece, F.lit(">"))).otherwise(F.concat(F.left(piece, F.length(piece) - F.length(tag)), _safe_tag(tag)))
        return let(F.regexp_extract(piece, _TAG, 0), kept)

    joined = let(pieces, lambda p: F.concat(F.array_join(F.transform(F.slice(p, 1, F.size(p) - 1), safe), ""), F.element_at(p, -1)))
    return stripped(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def summarize(x: Column, length: int = 280) -> Column:
    """The text up to `length` characters: to its last sentence end if that is past the middle, else to the last space and an ellipsis."""
    clean = squeezed(x)
    cut = F.substring(clean, 1, length)
    back = F.reverse(cut)
    ends = [F.when(F.instr(back, s) > 0, F.lit(length) - F.instr(back, s) - 1) for s in (" .", " !", " ?")]
    stop = F.greatest(*(F.coalesce(e, F.lit(-1)) for e in ends))
    space = F.when(F.instr(back, " ") > 0, F.lit(length) - F.instr(back, " ")).otherwise(F.lit(length - 1))
    return F.when(F.length(clean) <= length, clean).when(stop > length * 0.5, F.substr(cut, F.lit(1), stop + 1)).otherwise(F.concat(F.substr(cut, F.lit(1), space), F.lit("…")))


def clean_title(x: Column) -> Column:
    """The title without what boards append to it; the raw one if nothing is left."""
    raw = F.coalesce(x, F.lit(""))
    cleaned = lambda s: let(_without_noise(s), lambda out: F.when(out == "", stripped(raw)).otherwise(out))
    # all noise has one of these signs
    return let(squeezed(raw), lambda s: F.when(s.rlike(r"[,\-–—|/(]"), cleaned(s)).when(s == "", stripped(raw)).otherwise(s))


def _without_noise(out: Column) -> Column:
    for pattern, every in TITLE_NOISE:
        out = F.regexp_replace(out, pattern, " ") if every else first_replaced(out, pattern, " ")
    out = F.regexp_replace(out, r"\s{2,}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*[,\-–—|/]\s*$", ""), r"^\s*[,\-–—|/]\s*", ""))


def title_case(x: Column) -> Column:
    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(F.rlike(w, F.lit(r"^[A-Z0-9&/+.\-]{2,}$")), w)
            .when((i > 0) & low.isin(SMALL_WORDS), low)
            .when(F.rlike(w, F.lit(r"(?i)\b(i{1,3}|iv|v)\b")) & (F.length(w) <= 3), F.upper(w))
            .otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2))))
        )

    return F.array_join(F.transform(F.split(x, " ", -1), word), " ")


def normalize_title(x: Column) -> Column:
    return normalize_cleaned(clean_title(x))


#: What some pattern of TITLE_WORDS begins with, so that titles without any of it are left as they are.
_TITLE_HINT = r"(?i)\b(?:cyber|information|infosec|it|soc|siem|grc|iam|pam|dfir|appsec|devsecops|sr|jr|mgr|eng|analyst)"


def normalize_cleaned(title: Column) -> Column:
    """normalize_title of what clean_title has returned."""
    return let(title, lambda t: title_case(squeezed(F.when(t.rlike(_TITLE_HINT), reduce(lambda s, e: F.regexp_replace(s, *e), TITLE_WORDS, t)).otherwise(t))))


def title_key(x: Column) -> Column:
    return normalized_key(normalize_title(x))


def normalized_key(title: Column) -> Column:
    """title_key of what normalize_title has returned."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), rf"\b({SENIORITY_WORDS})\b", ""), "[^a-z0-9]+", "")


def slugify(x: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), *ACCENTS), r"[\u0300-\u036F]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "&", " and "), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def company_key(x: Column) -> Column:
    """The slug without up to four legal or geographic suffixes, never empty because of that."""
    # each step is computed once: written out, the fourth would hold 81 copies of the slug
    less = lambda key: let(F.regexp_replace(F.regexp_replace(key, f"-({COMPANY_SUFFIXES})$", ""), "-+$", ""), lambda rest: F.when(rest == "", key).otherwise(rest))
    key = slugify(x)
    for _ in range(4):
        key = let(key, less)
    return key


def location_key(city: Column, remote: Column) -> Column:
    return F.when(remote & (F.coalesce(city, F.lit("")) == ""), F.lit("remote")).otherwise(slugify(F.coalesce(city, F.lit("unknown"))))


def listing_id(source: Column, source_job: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", source, source_job)), 1, 16)


def fingerprint(title: Column, company: Column, city: Column, remote: Column) -> Column:
    return fingerprint_of(title_key(title), company, city, remote)


def fingerprint_of(key: Column, company: Column, city: Column, remote: Column) -> Column:
    """The fingerprint, from title_key."""
    return F.substring(F.sha1(F.concat_ws("|", key, company_key(company), location_key(city, remote))), 1, 20)


def keywords(x: Column, limit: int = 120) -> Column:
    """The most frequent tokens, ties by first place."""
    more = r"[a-z0-9+#.\-]"
    # a token that is too short or too long is "", so that what stands in it is no token either
    tokens = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(rf"([a-z]{more}{{2,29}}+)(?!{more})|[a-z]{more}*+"), F.lit(1))

    def wanted(found: Column) -> Column:
        return F.filter(found, lambda w: (w != "") & ~w.isin(STOP_WORDS))

    def repeats(t: Column) -> Column:
        """For each token found more than once, in the order of sorting: its further copies, each with a space behind it."""
        again = let(F.sort_array(t), lambda s: F.filter(s, lambda w, i: w == F.get(s, i - 1)))
        return F.regexp_extract_all(F.concat(F.array_join(again, " "), F.lit(" ")), F.lit(r"([^ ]++ )\1*+"), F.lit(0))

    def ranked(t: Column, copies: Column, words: Column) -> Column:
        placed = F.sort_array(F.transform(F.array_intersect(t, words), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        counted = F.zip_with(placed, copies, lambda p, r: F.struct((-F.length(r) / (F.length(p["w"]) + 1)).alias("n"), p["i"].alias("i"), p["w"].alias("w")))
        often = wanted(F.transform(F.sort_array(counted), lambda s: s["w"]))
        once = wanted(F.array_except(t, words))
        return let(often, lambda o: F.slice(F.when(F.size(o) < limit, F.concat(o, once)).otherwise(o), 1, limit))

    # only tokens found more than once are counted; the others follow as they stand in the text
    return let(tokens, lambda t: let(repeats(t), lambda r: let(F.transform(r, lambda y: F.substring_index(y, " ", 1)), lambda words: ranked(t, r, words))))


def overlap_similarity(a: Column, b: Column) -> Column:
    """Shared tokens of four and more letters, over the smaller token set; the first 400 tokens of each text count."""
    tokens = lambda x: F.array_distinct(F.slice(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]{4,}"), F.lit(0)), 1, 400))
    least = F.least(F.size(tokens(a)), F.size(tokens(b)))
    return F.when(least > 0, F.size(F.array_intersect(tokens(a), tokens(b))) / least).otherwise(F.lit(0.0))


def haystack(parts: list[Column]) -> Column:
    return F.lower(F.concat_ws(" \n ", *(F.coalesce(p, F.lit("")) for p in parts)))


def initials(x: Column, legal: str = "inc|ltd|llc|corp|co|the") -> Column:
    """First letters of the first two words that say something."""
    own = F.filter(F.split(squeezed(x), " "), lambda w: ~F.regexp_replace(F.lower(w), "[^a-z]", "").isin(legal.split("|")) & (w != ""))
    return F.upper(F.array_join(F.transform(F.slice(own, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def tint(x: Column, tints: int = 6) -> Column:
    """A stable colour number from 32-bit overflowing arithmetic over the characters."""
    wrap = lambda v: F.pmod(v + 2**31, F.lit(2**32)) - 2**31
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.ascii(F.substr(x, i, F.lit(1))).cast("long"))
    return (F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))) % tints).cast("int")
