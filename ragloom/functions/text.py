"""Scalar text functions as column expressions: citations, titles, terms, speech, masking, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and word lists that callers rely on.
CITATION = r"\[(\d+(?:\s*[-,，、]\s*\d+)*)\]"
EMPTY_TITLE = "新对话"
REWRITE_HINTS = ("它", "他", "她", "这个", "那个", "这些", "那些", "该", "此", "上面", "上述", "前面", "刚才", "呢", "还有", "继续", "那么", "然后")
STATUS_PROGRESS = {"PENDING": 5, "PARSING": 35, "EMBEDDING": 75, "READY": 100, "FAILED": 0, "DELETED": 0}
RESERVED_DOMAINS = ("example.com", "example.org", "example.net")
STOP_TERMS = tuple(
    "a an the and or but if then than so in on at to for of with by from into is are was were be been being do does did done have has had "
    "can could will would should may might must it its this that these those there here how why what when where which who whom whose "
    "i me my we us our you your he she they them choose chose chosen use used using make made take took get got give gave go went come came "
    "think knew know say said tell told ask asked need want like work worked works working project projects team company job role "
    "good bad better best great more most less much many some any all both each every yes no not ok okay well also just only very "
    "about after before during over under between approach method way reason point thing things part side case time times year years day days "
    "vs etc eg ie pm am ps".split()
)
SPOKEN_TERMS = {"QPS": "Q P S", "TPS": "T P S", "RTF": "R T F", "MRR": "M R R", "RRF": "R R F", "BM25": "B M 二十五", "Top-K": "Top K", "top-k": "top K", "e.g.": "例如", "i.e.": "也就是", "vs.": "对比", "etc.": "等等"}
SPOKEN_SIGNS = {"⇒": "到", "←": "到", "&": "和", "|": "，", "•": "，", "·": "，", "…": "。", "『": "「", "』": "」"}
CUT_SIGNS = ("。", "！", "？", "；", ".", "!", "?", "\n")
PREAMBLES = ("好的", "好", "了解了", "了解", "明白了", "明白", "嗯", "呃", "那么", "接下来", "下一个问题", "下面", "问题", "提问", "我想问一下", "我想问", "请问")
REWRITE_LABELS = ("改写后", "检索查询", "查询")
MP3_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def cited_numbers(text: Column) -> Column:
    """Numbers cited as ``[1]``, ``[1,2]``, ``[1-3]``, in order, once each; reversed ranges and those of over 21 are dropped."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    pieces = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"\s", ""), "[,，、]")))

    def expand(piece: Column) -> Column:
        ends = F.split(piece, "-")
        a, b = F.element_at(ends, 1).try_cast("int"), F.element_at(ends, -1).try_cast("int")
        return F.when((F.size(ends) <= 2) & (b >= a) & (b <= a + 20), F.sequence(a, F.greatest(a, F.least(b, a + 20)))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(pieces, expand)))


def valid_citations(text: Column, n: Column) -> tuple[Column, Column]:
    """(valid, invalid) numbers of a text with ``n`` contexts."""
    numbers = cited_numbers(text)
    return F.filter(numbers, lambda x: x.between(1, n)), F.filter(numbers, lambda x: ~x.between(1, n))


def strip_citations(text: Column, n: Column) -> Column:
    """Without the brackets that have an invalid number; spaces are tidied only then."""
    brackets = F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))
    bad = F.filter(brackets, lambda b: F.exists(cited_numbers(b), lambda x: ~x.between(1, n)))
    out = F.aggregate(bad, text, lambda t, b: F.replace(t, b, F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"\s+([，。；：,.!?;])", "$1")
    return F.regexp_replace(F.when(F.size(bad) > 0, tidy).otherwise(text), r"^\s+|\s+$", "")


def title(text: Column) -> Column:
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(one == "", EMPTY_TITLE).when(F.char_length(one) > 40, F.concat(F.substring(one, 1, 40), F.lit("…"))).otherwise(one)


def needs_rewrite(question: Column) -> Column:
    return (F.char_length(F.trim(question)) <= 8) | F.exists(F.array(*[F.lit(h) for h in REWRITE_HINTS]), lambda h: F.contains(question, h))


def terms(text: Column) -> Column:
    """Distinct technical terms, sorted by their lower case and spelt as they come first: no stop words, and
    none under three letters that is all lower case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9+#.\-]+"), F.lit(0)), lambda t: F.btrim(t, F.lit(".-")))
    keyed = F.transform(found, lambda t, i: F.struct(F.lower(t).alias("k"), i.alias("i"), t.alias("t")))
    told = F.array_sort(F.filter(keyed, lambda x: (F.char_length(x["k"]) >= 2) & ~x["k"].isin(*STOP_TERMS) & ((F.char_length(x["k"]) >= 3) | (x["k"] != x["t"]))))
    # an array of one binds the sorted terms, or each would sort them again
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))
    return F.transform(F.get(F.transform(F.array(told), first), F.lit(0)), lambda x: x["t"])


def grounded(found: Column, source: Column) -> Column:
    """The terms that the source has. An array of one binds the lowered source, or each term would lower it again."""
    kept = F.transform(F.array(F.lower(F.coalesce(source, F.lit("")))), lambda s: F.filter(found, lambda t: F.contains(s, F.lower(t))))
    return F.element_at(kept, 1)


def traceability(question: Column, source: Column) -> Column:
    """(ok, unknown, grounded): whether the source has all technical terms of a question, and which."""
    own = grounded(terms(question), source)
    unknown = F.array_except(terms(question), own)
    return F.struct((F.size(unknown) == 0).alias("ok"), unknown.alias("unknown"), own.alias("grounded"))


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def strip_markdown(text: Column) -> Column:
    """Without code blocks, table rules, link targets, addresses, citations, inline marks, line signs and emoji."""
    mark = (r"(?s)(\*{1,3}|_{1,3}|~~)(?=\S)(.*?)(?<=\S)\1", "$2")
    return _replaced(text, [
        (r"(?s)```.*?```", " "), (r"(?m)^\s*\|?[\s:|-]{3,}\|?\s*$", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"https?://\S+", ""),
        (r"\[\s*\d+\s*(?:[,\-–]\s*\d+\s*)*\]", ""), (r"`([^`]*)`", "$1"), mark, mark, mark,
        (r"(?m)^\s{0,3}(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s*)", ""),
        (r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{1f000}-\x{1f2ff}\x{fe0f}]+", ""),
    ])


def strip_signs(text: Column) -> Column:
    """Ranges as a word, arrows as pauses (none after a sentence), and signs that aren't read out."""
    text = _replaced(text, [(r"(?<=\d)\s*[~～]\s*(?=\d)", "到"), (r"([。！？；!?;])\s*[→⇒]\s*", "$1"), (r"\s*[→⇒]\s*", "，"), ("[~～]", "")])
    return F.translate(text, "".join(SPOKEN_SIGNS), "".join(SPOKEN_SIGNS.values()))


def spell_terms(text: Column) -> Column:
    """Abbreviations as they are read out, where no letter or digit touches them."""
    for term, told in SPOKEN_TERMS.items():
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9])\Q{term}\E(?![A-Za-z0-9])", told)
    return text


def tidy_spoken(text: Column) -> Column:
    """No empty brackets, runs of spaces, doubled signs, signs at line starts, or empty lines."""
    return F.btrim(_replaced(text, [
        (r"[（(]\s*[)）]", ""), (r"【\s*】", ""), (r"[ \t\x{3000}]+", " "), (r"[，,]\s*(?=[，,。！？；])", ""), (r"([。！？；])\1+", "$1"),
        (r"\n\s*([，,。！？；：])", "$1"), (r"(?m)[ \t]+$", ""), (r"\n{2,}", "\n"),
    ]), F.lit(" \t\n\r\x0b\x0c\u3000"))


def spoken(text: Column, max_chars: int = 2000) -> Column:
    """Markdown as plain speech, cut at a sentence end; null as empty."""
    return cut_at_sentence(tidy_spoken(spell_terms(strip_signs(strip_markdown(F.coalesce(text, F.lit("")))))), max_chars)


def cut_at_sentence(text: Column, limit: int) -> Column:
    """Cut after the last sign of the first kind (in the order of ``CUT_SIGNS``) that keeps 40 % of ``limit``."""
    head = F.substring(text, 1, limit)
    ends = [F.char_length(head) - F.locate(sign, F.reverse(head)) + 1 for sign in CUT_SIGNS]
    cut = F.coalesce(*[F.when(F.contains(head, F.lit(sign)) & (end - 1 >= limit * 0.4), F.substring(head, F.lit(1), end)) for sign, end in zip(CUT_SIGNS, ends, strict=True)], head)
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def clean_question(text: Column) -> Column:
    """A generated question without quotes and up to six layers of what leads up to it."""
    signs = r"[，,。.、：:；;\s]*"
    lead = "|".join(PREAMBLES)
    bare = F.trim(F.btrim(F.trim(F.coalesce(text, F.lit(""))), F.lit('"')))
    return F.trim(F.regexp_replace(bare, rf"^(?:(?:{lead}){signs}){{1,6}}", ""))


def clean_rewrite(text: Column, question: Column) -> Column:
    """A rewritten query without quotes and label; the question itself if nothing is left."""
    bare = F.btrim(F.trim(F.coalesce(text, F.lit(""))), F.lit("\"“”'"))
    bare = F.trim(F.regexp_replace(bare, rf"^(?:{'|'.join(REWRITE_LABELS)})[:：]\s*", ""))
    return F.when(bare == "", question).otherwise(bare)


def mask_dsn(url: Column) -> Column:
    """A connection address without its password."""
    return F.regexp_replace(url, r"^(.*?://)([^:]*?)(?::.*)?@([^@]*)$", "$1$2:***@$3")


def display_lines(text: Column, width: float) -> Column:
    """Lines of a display width: a sign beyond Latin counts 1, others 0.6; a line breaks before what would exceed it."""
    fresh = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"), F.lit(0.0).alias("used"))

    def step(acc: Column, sign: Column) -> Column:
        size = F.when(F.ascii(sign) > 0x2E7F, 1.0).otherwise(0.6)
        full = (acc["used"] + size > width) & (acc["line"] != "")
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["line"])).otherwise(acc["done"]).alias("done"),
            F.when(full, sign).otherwise(F.concat(acc["line"], sign)).alias("line"),
            F.when(full, size).otherwise(acc["used"] + size).alias("used"),
        )

    signs = F.filter(F.split(text, ""), lambda x: x != "")
    return F.aggregate(signs, fresh, step, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["line"])))


def personal_data(text: Column) -> Column:
    """Array of (kind, value): phone, identity number, and e-mail outside the reserved domains."""
    hits = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    mails = F.filter(hits("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), lambda x: ~F.lower(F.element_at(F.split(x["value"], "@"), -1)).isin(*RESERVED_DOMAINS))
    return F.concat(hits("phone", r"\b1[3-9][0-9]{9}\b"), hits("id", r"\b[0-9]{17}[0-9Xx]\b"), mails)


def mask_secret(value: Column) -> Column:
    return F.when(F.char_length(value) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(value, F.lit(4))))


def first_json(output: Column) -> Column:
    """The text from the first brace to the last, without a code fence."""
    return F.regexp_extract(F.regexp_replace(output, r"```\w*", ""), r"(?s)(\{.*\})", 1)


def clamped(value: Column) -> Column:
    """Between 0 and 1; what is no number is 0."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value.try_cast("double"))), F.lit(0.0))


def judge_scores(output: Column) -> Column:
    """(faithfulness, correctness, reason, graded) of a judge's JSON, fenced or embedded; garbage scores nothing."""
    parsed = F.from_json(first_json(output), "faithfulness string, correctness string, reason string")
    return F.struct(
        clamped(parsed["faithfulness"]).alias("faithfulness"), clamped(parsed["correctness"]).alias("correctness"),
        F.substring(F.coalesce(parsed["reason"], F.lit("")), 1, 200).alias("reason"), parsed["faithfulness"].isNotNull().alias("graded"),
    )


def mp3_rate(data: Column) -> Column:
    """Sample rate of the first valid frame header in the first 512 bytes, null if there is none."""
    head = F.hex(F.substring(data, 1, 512))
    byte = lambda i, k: F.conv(F.substring(head, 2 * (i + k) + 1, F.lit(2)), 16, 10).cast("int")
    rates = F.create_map(*[F.lit(x) for version, row in MP3_RATES.items() for at, rate in enumerate(row) for x in (version * 4 + at, rate)])
    last = F.floor(F.char_length(head) / 2).cast("int") - 4

    def rate(i: Column) -> Column:
        synced = (byte(i, 0) == 255) & (byte(i, 1) >= 224)
        # version and rate index; versions and indices that the table hasn't are reserved
        return F.when(synced, F.try_element_at(rates, (F.floor(byte(i, 1) / 8) % 4 * 4 + F.floor(byte(i, 2) / 4) % 4).cast("int")))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), rate), lambda x: x.isNotNull())
    return F.when(last >= 0, F.get(found, F.lit(0)))


def audio_rate(data: Column, name: Column) -> Column:
    """Sample rate by the name's ending or the first bytes; null for other formats."""
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    wav = (ending == "wav") | (F.substring(data, 1, 4) == F.lit(b"RIFF"))
    return F.when(wav, wav_rate(data)).when(ending.isin("mp3", "mp2") | (F.substring(data, 1, 3) == F.lit(b"ID3")), mp3_rate(data))


def wav_rate(data: Column) -> Column:
    """Sample rate of a RIFF/WAVE header, null if it isn't a sane one."""
    rate = F.conv(F.hex(F.concat(*[F.substring(data, i, 1) for i in (28, 27, 26, 25)])), 16, 10).cast("long")
    return F.when((F.substring(data, 1, 4) == F.lit(b"RIFF")) & (F.substring(data, 9, 4) == F.lit(b"WAVE")) & rate.between(8000, 192000), rate)


def next_action(depth: Column, max_depth: Column, level: Column, specificity: Column, tradeoff: Column, vague: Column) -> Column:
    """Follow up or go on, from the depth of a topic and the evaluation of the last answer."""
    return (
        F.when(depth >= max_depth, "NEXT_TOPIC")
        .when((level == "deep") & tradeoff & (specificity >= 0.7), "NEXT_TOPIC")
        .when((level == "shallow") | (specificity < 0.5) | (vague > 0), "FOLLOW_UP")
        .when(depth < 1, "FOLLOW_UP")
        .otherwise("NEXT_TOPIC")
    )


def placeholders(text: Column) -> Column:
    """Names in braces that were never filled in, as they stand."""
    return F.regexp_extract_all(text, F.lit(r"\{[A-Za-z_][A-Za-z0-9_]*\}"), F.lit(0))
