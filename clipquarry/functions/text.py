"""Text expressions: normalising, tokens, similarity, keywords, hashtags, descriptions and time codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import col, fixed

TOKEN = r"[\p{L}\p{N}]+"
STOPS = ".!?" + "。！？"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once, however often it is used, also in branches."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def tokens(x: Column | str) -> Column:
    """Letter-and-digit runs, lower case, ё as е; null has none."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("ё"), F.lit("е")), F.lit(TOKEN), F.lit(0))


def normalised(x: Column | str) -> Column:
    return F.array_join(tokens(x), " ")


def clean(x: Column | str) -> Column:
    """White space collapsed and trimmed; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+", " "))


def sentences(x: Column | str) -> Column:
    """Split after . ! ? (also the wide ones) and white space."""
    return F.filter(F.split(clean(x), rf"(?<=[{STOPS}])\s+"), lambda s: s != "")


def sentences_without_quotes(x: Column | str) -> Column:
    """The other splitter: after . ! ? …, closing quotes and brackets at the break go."""
    return F.filter(F.split(clean(x), r"(?<=[.!?…])[\"»”’)\]]*\s+"), lambda s: s != "")


def topic_tokens(title: Column | str, quote: Column | str) -> Column:
    both = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(quote), F.lit("")))
    return F.array_distinct(F.filter(tokens(both), lambda t: F.length(t) >= 3))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Set similarity; one empty side is 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(fixed(F.size(F.array_intersect(a, b)) / union))


def content_stems(x: Column | str) -> Column:
    """Distinct 5-letter beginnings of words of 6 letters or more; one expression that matches these words only."""
    return F.array_distinct(F.regexp_extract_all(F.replace(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("ё"), F.lit("е")), F.lit(r"(\p{L}{5})\p{L}++"), F.lit(1)))


def said_length(x: Column | str) -> Column:
    """Characters without the blanks at the ends; null for null."""
    return F.length(F.trim(col(x)))


FAITHFUL = {"max_novel": 0.08, "min_coverage": 0.5, "min_length": 0.3, "max_length": 1.1}


def faithfulness(source: Column | str, edited: Column | str, limits: dict[str, float] | None = None) -> Column:
    """struct(novel, coverage, length, ok, reasons) of an edit against its source."""
    return stem_faithfulness(content_stems(source), content_stems(edited), said_length(source), said_length(edited), limits)


def stem_faithfulness(a: Column, b: Column, na: Column, nb: Column, limits: dict[str, float] | None = None) -> Column:
    """The same of the stems and the lengths of both. Novel is the share of the edit's stems that the source lacks, 0 without stems; coverage the share of the source's that the edit has, 1 without. Each part is worked out once."""
    lim = FAITHFUL | (limits or {})
    length = F.when(F.coalesce(na, F.lit(0)) == 0, 0.0).otherwise(fixed(F.coalesce(nb, F.lit(0)) / na))

    def shares(x: Column) -> Column:
        n = F.when(x["b"] == 0, 0.0).otherwise(fixed((x["b"] - x["both"]) / x["b"]))
        return F.struct(n.alias("novel"), F.when(x["a"] == 0, 1.0).otherwise(fixed(x["both"] / x["a"])).alias("coverage"), x["length"].alias("length"))

    def told(x: Column) -> Column:
        n, c, r = x["novel"], x["coverage"], x["length"]
        reasons = F.array_compact(F.array(F.when(n > lim["max_novel"], "novel words"), F.when(c < lim["min_coverage"], "low coverage"), F.when(r < lim["min_length"], "too short"), F.when(r > lim["max_length"], "too long")))
        return let(reasons, lambda y: F.struct(n.alias("novel"), c.alias("coverage"), r.alias("length"), (F.size(y) == 0).alias("ok"), y.alias("reasons")))

    counts = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"), F.size(F.array_intersect(s["b"], s["a"])).alias("both"), length.alias("length")))
    return let(let(counts, shares), told)


def trimmed(x: Column | str, most: int) -> Column:
    """At most ``most`` characters: cut at the last space if that keeps 70 %, without trailing marks, with three dots."""
    limit = most - 3

    def cut(t: Column) -> Column:
        def at(c: Column) -> Column:
            space = F.length(c) - F.locate(" ", F.reverse(c))
            whole = F.when((F.locate(" ", F.reverse(c)) > 0) & (space >= int(limit * 0.7)), F.substring(c, F.lit(1), space)).otherwise(c)
            return F.concat(F.regexp_replace(whole, r"[ ,;:.\-]+$", ""), F.lit("..."))

        return F.when(F.length(t) <= most, t).otherwise(let(F.rtrim(F.substring(t, 1, limit)), at) if most > 3 else F.substring(t, 1, most))

    return let(clean(x), cut)


def excerpt(x: Column, most: int) -> Column:
    """At most ``most`` characters and an ellipsis; cut at the last space if that keeps over 60 %."""
    cut = F.substring(x, 1, most)
    space = most - F.locate(" ", F.reverse(cut))
    at = F.when((F.locate(" ", F.reverse(cut)) > 0) & (space > most * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(at), F.lit("…")))


def first_lines(x: Column, most: int, least: float = 0.8) -> Column:
    """At most ``most`` characters, back to the last line end if that keeps over ``least`` of them."""
    cut = F.substring(x, 1, most)
    line = most - F.locate("\n", F.reverse(cut))
    at = F.when((F.locate("\n", F.reverse(cut)) > 0) & (line > most * least), F.substring(cut, F.lit(1), line)).otherwise(cut)
    return F.when(F.length(x) <= most, x).otherwise(at)


def normalise_hashtag(x: Column | str) -> Column:
    t = F.lower(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[^\p{L}\p{N}_]+", ""))
    return F.when(t != "", F.concat(F.lit("#"), t))


#: Words that are no keywords, shortest first.
STOPWORDS = (
    "a an as at be by do he if in is it me my no of on or so to up we and are but can did for had has her him his how its may not our out she the was who why you been does from have here "
    "into just like more most over some than that them then they this very were what when will with your could doing their there these those under where which would having because through "
    "а в и к о с у я бы да до ее же за из им их ли мы на не ни но об он от по со то без был вам вас вот все всю где для его еще или как кто мне над нее нет обо она они оно под при про раз сам сво так там тут уже чем что эта эти это "
    "была были весь всех даже если лишь него одна тоже хотя этот какой когда может после такие такой через чтобы только"
).split()
TYPE_TAGS = {"story": "story podcast reels shorts viral".split(), "highlight": "highlight podcast reels shorts viral".split(), "long_reel": "longreel podcast reels shorts viral".split(), "reel": "podcast reels shorts interview viral".split()}
KEYWORD = "[A-Za-zА-Яа-яЁё0-9]+"
TAGS = 5


def keywords(x: Column | str) -> Column:
    """Latin and Cyrillic words but numbers, single letters and stop words, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(KEYWORD), F.lit(0))
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^[0-9]+$") & ~t.isin(*STOPWORDS))


def given_tags(tags: Column) -> Column:
    """The tags in an array of texts; a text may hold several."""
    return F.flatten(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))


def hashtags(given: Column, sources: list[Column | str], bucket: Column, most: int = TAGS) -> Column:
    """The first ``most`` distinct of the given tags, the keywords of the sources in turn and the tags of the type. A source is looked at only where those before it do not give enough."""
    types = F.coalesce(*[F.when(bucket == k, F.array(*map(F.lit, v))) for k, v in TYPE_TAGS.items()], F.array(*map(F.lit, TYPE_TAGS["reel"])))
    tags = lambda raw: F.array_distinct(F.array_compact(F.transform(raw, normalise_hashtag)))

    def more(acc: Column, rest: list[Callable[[], Column]]) -> Column:
        if not rest:
            return acc
        return F.when(F.size(acc) >= most, acc).otherwise(let(F.array_distinct(F.concat(acc, tags(rest[0]()))), lambda a: more(a, rest[1:])))

    steps = [lambda x=x: keywords(x) for x in sources] + [lambda: types]
    return F.slice(let(tags(given_tags(given)), lambda a: more(a, steps)), 1, most)


_UP, _ANY = "[A-ZА-ЯЁ]", "A-Za-zА-Яа-яЁё"
#: What a text is about, likeliest first: initials and a number, a word with a digit in it, a name and a number, capitals.
TOPICS = (
    rf"{_UP}(?:&{_UP})+\s+[0-9]+[{_ANY}]*",
    rf"{_UP}[{_ANY}0-9&/-]*[0-9](?:[{_ANY}0-9&/-]*[{_ANY}0-9])?",
    rf"{_UP}[{_ANY}]{{2,}}\s+[0-9]+[{_ANY}]*",
    rf"{_UP}{{2,}}(?:[&/-][A-ZА-ЯЁ0-9]+)*",
)


def subject(*fields: Column | str) -> Column:
    """What a text is about: the first of the topic patterns in the first field that has any; '' if none has."""
    # the first letter is looked for before what stands before it
    edge = rf"(?={_UP})(?<![\p{{L}}\p{{N}}_])(?:%s)(?![\p{{L}}\p{{N}}_])"
    topic = lambda f: F.coalesce(*[F.nullif(F.regexp_extract(f, edge % p, 0), F.lit("")) for p in TOPICS], F.lit(""))
    found = F.aggregate(F.array(*[F.coalesce(col(f), F.lit("")) for f in fields]), F.lit(""), lambda acc, f: F.when(acc != "", acc).otherwise(let(without_hashtags(f), topic)))
    return F.regexp_replace(found, r"\s+", " ")


#: Nouns that say nothing by themselves after "this": stem and the endings that may follow it, and those of one form.
_VAGUE = {"систем": "ауеы", "игр": "ауеы", "подкаст": "ауеы", "книг": "ауеы", "фильм": "ауеы", "сериал": "ауеы", "проект": "ауеы", "момент": "ауеы", "штук": "ауеы", "сцен": "ауеы", "правил": "ауеы", "редакц": "июеы", "ситуац": "июеы", "кампани": "юеи", "истори": "юеи", "иде": "юеи", "вещ": "ьауеы"}
_VAGUE_FORMS = "видео тему теме механику механике редакции ситуации идее истории"
_THIS = "эт(?:а|и|о|у|их|ой|ом|от)"
VAGUE = rf"{_THIS}\s+(?:" + "|".join([f"{stem}[{ends}]?" for stem, ends in _VAGUE.items()] + _VAGUE_FORMS.split()) + ")"


_VAGUE_PHRASE = rf"(?iu)(?=э)(?<![\p{{L}}\p{{N}}_])(?:{VAGUE})(?![\p{{L}}\p{{N}}_])"


def rewrite_vague(x: Column, by: Column) -> Column:
    """Phrases like "this game" replaced by the subject, taken as it stands; the subject is worked out only for texts that have one."""
    return F.when(~x.rlike(_VAGUE_PHRASE), x).otherwise(let(by, lambda b: F.when(b != "", F.regexp_replace(x, F.lit(_VAGUE_PHRASE), b)).otherwise(x)))


def without_hashtags(x: Column | str) -> Column:
    t = F.regexp_replace(clean(x), r"#(?<![\p{L}\p{N}_]#)[\p{L}\p{N}_]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+([,.!?;:])", "$1"), r"\s\s+", " "))


NOTHING_SAID = {True: "Сильный момент из подкаста.", False: "Strong podcast moment."}


def description(caption="caption", hook="hook", title="title", quote="quote", why="why", most: int = 1000) -> Column:
    """The caption, its vague phrases made specific; without one, hook, title, quote and why in a row."""
    parts = F.array_join(F.filter(F.transform(F.array(*[F.coalesce(col(x), F.lit("")) for x in (hook, title, quote, why)]), without_hashtags), lambda p: p != ""), " ")
    base = let(without_hashtags(caption), lambda c: F.when(c != "", c).otherwise(parts))
    nothing = F.when(cyrillic(F.concat_ws(" ", title, hook, quote, why, caption)), NOTHING_SAID[True]).otherwise(NOTHING_SAID[False])
    return trimmed(let(base, lambda b: F.when(b == "", nothing).otherwise(rewrite_vague(b, subject(title, hook, quote, why)))), most)


def cyrillic(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike("[А-Яа-яЁё]"), F.lit(False))


def reel_index(path: Column | str) -> Column:
    """The number of a reel's file name, null if it has none above 0."""
    n = F.regexp_extract(F.coalesce(col(path), F.lit("")), r"(?:^|/)reel_([0-9]{1,9})(?:_[0-9]+)?\.[A-Za-z0-9.]+$", 1).try_cast("int")
    return F.when(n > 0, n)


def bare_word(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}]", "")


def font_name(path: Column | str) -> Column:
    return F.initcap(F.translate(F.regexp_extract(col(path), r"([^/]*?)(?:\.[^./]*)?$", 1), "_-", "  "))


def model_folder(x: Column | str) -> Column:
    """A folder name for a model: letters, digits, _ and - stay, what parts a name's pieces becomes _, all else goes."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(col(x), F.lit("")))), "[:./ ]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\-]+", ""), r"^_+|_+$", ""), F.lit("")), F.lit("model"))


def escape_filter(x: Column | str) -> Column:
    r"""\ ' : % escaped for a filter string."""
    out = col(x)
    for a, b in (("\\", "\\\\"), ("'", "\\'"), (":", "\\:"), ("%", "\\%")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def prompt_language(explicit: Column | str, detected: Column | str, default: str = "ru") -> Column:
    e, d = F.lower(F.trim(F.coalesce(col(explicit), F.lit("")))), F.lower(F.trim(F.coalesce(col(detected), F.lit(""))))
    return F.when(e.isin("ru", "en"), e).when(d.startswith("ru"), "ru").when(d.startswith("en"), "en").otherwise(default)


def requirements(quotas: dict[str, int]) -> str:
    """A line for each kind that is wanted."""
    return "\n".join(f"- {n} x {kind}" for kind, n in quotas.items() if n > 0)


def render(template: str, values: dict[str, Column | str]) -> Column:
    """{key} replaced one after the other, as plain text."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(col(v).cast("string"), F.lit("")))
    return out


def wrapped_prompt(prompt: Column | str, style: str) -> Column:
    return {"turns": F.concat(F.lit("<start_of_turn>user\n"), col(prompt), F.lit("<end_of_turn>\n<start_of_turn>model\n")), "roles": F.concat(F.lit("<|turn>user\n"), col(prompt), F.lit("<turn|>\n<|turn>model\n"))}.get(style, col(prompt))


def color(hexa: Column | str, opacity: Column | float = 1.0) -> Column:
    """#RRGGBB and an opacity as &HAABBGGRR."""
    h, o = F.upper(F.regexp_replace(col(hexa), "^#", "")), opacity if isinstance(opacity, Column) else F.lit(opacity)
    alpha = F.lpad(F.hex(F.floor((1 - o) * 255 + 0.5).cast("long")), 2, "0")
    return F.concat(F.lit("&H"), alpha, F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def file_size(n: Column | str) -> Column:
    x = col(n)
    return F.when(x < 1024, F.concat(x.cast("string"), F.lit(" B"))).when(x < 1 << 20, F.format_string("%.1f KB", x / 1024)).otherwise(F.format_string("%.1f MB", x / (1 << 20)))


# -- time codes, from whole milliseconds


def _two(x: Column) -> Column:
    # lpad cuts what is longer
    s = x.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def _part(ms: Column, unit: int, mod: int | None = None) -> Column:
    q = F.floor(ms / unit).cast("long")
    return q if mod is None else q % mod


def srt_time(ms: Column | str) -> Column:
    m = F.greatest(col(ms).cast("long"), F.lit(0).cast("long"))
    return F.concat(_two(_part(m, 3_600_000)), F.lit(":"), _two(_part(m, 60_000, 60)), F.lit(":"), _two(_part(m, 1000, 60)), F.lit(","), F.lpad((m % 1000).cast("string"), 3, "0"))


def ass_time(ms: Column | str) -> Column:
    m = F.greatest(col(ms).cast("long"), F.lit(0).cast("long"))
    return F.concat(_part(m, 3_600_000).cast("string"), F.lit(":"), _two(_part(m, 60_000, 60)), F.lit(":"), _two(_part(m, 1000, 60)), F.lit("."), _two(_part(m, 10, 100)))


def hms(ms: Column | str) -> Column:
    m = F.greatest(col(ms).cast("long"), F.lit(0).cast("long"))
    h = _part(m, 3_600_000)
    short = F.concat(_two(_part(m, 60_000, 60)), F.lit(":"), _two(_part(m, 1000, 60)))
    return F.when(h > 0, F.concat(_two(h), F.lit(":"), short)).otherwise(short)
