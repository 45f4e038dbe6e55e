"""Text scalars on the JVM: bigram similarity, tokens, noise rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a decision, words that alone are noise, and subjects of small talk.
DECISION_SIGNALS = [
    "决定", "确认", "采用", "选择", "结论", "通过", "方案", "选型", "批准", "同意", "拒绝",
    "decide", "confirm", "adopt", "select", "choose", "approve", "agree", "reject", "conclusion",
]
NOISE_WORDS = [
    "好的", "收到", "嗯", "哦", "ok", "好", "行", "是", "对", "嗯嗯", "哈哈", "嘿嘿", "谢谢", "感谢", "辛苦了", "赞",
    "+1", "1", "yes", "no", "thanks", "thx", "got it", "sure", "lol", "haha", "nice", "good", "well",
]
NOISE_TOPICS = [
    "天气", "下雨", "太阳", "温度", "热", "冷", "吃饭", "午餐", "晚餐", "早餐", "外卖", "食堂",
    "周末", "假期", "旅游", "电影", "游戏", "综艺", "地铁", "公交", "堵车", "迟到",
]
MIN_LENGTH = 5
# What a comment on a document may consist of without saying anything.
DOC_NOISE = ["LGTM", "lgtm", "+1", "👍", "好的", "收到"]
# Code points of emoji; those that make a short message mostly emoji; beginnings of a new subject.
EMOJI = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{FE00}-\x{FE0F}\x{200D}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}"
MOSTLY_EMOJI = r"\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{2615}"
TOPIC_SHIFTS = [
    "对了", "话说", "另外", "换个话题", "顺便问", "说起来", "对了另外", "回到", "说回", "插一句",
    "ok next", "anyway", "by the way", "还有一个", "还有件事", "另外一件事",
]
# Words of code and tools.
CODE_KEYWORDS = [
    "refactor", "migration", "bump", "upgrade", "downgrade", "deprecate", "optimize", "rewrite", "revert", "merge", "deploy", "release",
    "import", "export", "config", "configure", "setup", "install", "database", "schema", "table", "query", "index", "cache",
    "api", "endpoint", "route", "middleware", "lambda", "function", "class", "module", "package", "library", "framework", "tool",
    "test", "mock", "assert", "coverage", "ci", "cd", "docker", "container", "k8s", "kubernetes", "deployment",
    "auth", "login", "permission", "role", "error", "bug", "fix", "hotfix", "patch", "pr", "pull request", "review", "lgtm", "approve",
]
# Languages by extension, and extensions of files that aren't text.
LANGUAGES = {
    ".py": "Python", ".md": "Markdown", ".toml": "TOML", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".cfg": "Config", ".ini": "Config",
    ".env": "Environment", ".go": "Go", ".rs": "Rust", ".ts": "TypeScript", ".tsx": "TypeScript React", ".js": "JavaScript",
    ".jsx": "JavaScript React", ".css": "CSS", ".scss": "SCSS", ".html": "HTML", ".sql": "SQL", ".sh": "Shell", ".zsh": "Shell",
    ".bash": "Shell", ".gradle": "Gradle", ".kt": "Kotlin", ".rb": "Ruby", ".php": "PHP", ".java": "Java", ".c": "C", ".cpp": "C++",
    ".h": "C Header", ".hpp": "C++ Header", ".proto": "Protobuf", ".graphql": "GraphQL",
}
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".o", ".so", ".dylib", ".exe", ".dll",
    ".pyc", ".pyo", ".pyd", ".zip", ".tar", ".gz", ".bz2", ".7z", ".db", ".sqlite", ".db3", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".mp3", ".mp4", ".avi", ".mov", ".ds_store",
]
IGNORED_FOLDERS = [
    ".git", "__pycache__", ".venv", "venv", ".tox", "node_modules", ".next", "dist", "build", ".build",
    ".egg-info", ".mypy_cache", ".pytest_cache", ".claude", ".cursor", ".idea", ".vscode",
]


def strip(text: Column) -> Column:
    """Without white space at the ends; null stays null."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; an empty array under two characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def bigram_jaccard(a: Column, b: Column, stripped: bool = True) -> Column:
    """Similarity of two texts, lower-cased and, unless told otherwise, stripped."""
    clear = strip if stripped else (lambda t: t)
    return jaccard(bigrams(F.lower(clear(a))), bigrams(F.lower(clear(b))))


def characters(text: Column) -> Column:
    """Distinct characters of a text."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def character_overlap(a: Column, b: Column) -> Column:
    """Shared distinct characters over those of the richer text, whatever the case; 0 if one is empty or null."""
    x, y = characters(F.lower(F.coalesce(a, F.lit("")))), characters(F.lower(F.coalesce(b, F.lit(""))))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / most)


def character_containment(part: Column, whole: Column) -> Column:
    """The share of distinct characters of ``part``, but white space, that ``whole`` has; 0 for a ``part`` of under three."""
    x, y = (characters(F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", ""))) for t in (part, whole))
    return F.when((F.size(x) < 3) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def quote_found(quote: Column, message: Column) -> Column:
    """Whether a message holds a quote, or over 0.6 of the quote's characters, counted with repetition."""
    letters = F.filter(F.split(quote, ""), lambda c: c != "")
    held = F.size(F.filter(letters, lambda c: F.contains(message, c)))
    return F.contains(message, quote) | ((F.size(letters) > 0) & (held > 0.6 * F.size(letters)))


def overlap_tokens(text: Column) -> Column:
    """Distinct runs of Chinese characters, of letters with digits, and of digits, lower-cased."""
    found = lambda pattern: F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)
    return F.array_distinct(F.concat(found(r"[\x{4e00}-\x{9fff}]+"), found(r"[a-z][a-z0-9]*"), found(r"[0-9]+")))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the poorer text; 0 if one has none."""
    x, y = overlap_tokens(a), overlap_tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def extract_words(text: Column) -> Column:
    """White-space words of two characters or more without marks at their ends, lower-cased, and all runs of 2 to 4 Chinese characters."""
    clear = F.coalesce(text, F.lit(""))
    plain = F.transform(F.split(clear, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$", "")))
    places = F.when(F.length(clear) >= 2, F.sequence(F.lit(1), F.length(clear) - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(places, lambda i: F.transform(F.array(F.lit(4), F.lit(3), F.lit(2)), lambda n: F.substring(clear, i, n))))
    sized = F.transform(places, lambda i: F.transform(F.array(F.lit(4), F.lit(3), F.lit(2)), lambda n: i + n - 1 <= F.length(clear)))
    chinese = F.filter(F.arrays_zip(runs.alias("w"), F.flatten(sized).alias("whole")), lambda x: x["whole"] & x["w"].rlike(r"^[\x{4e00}-\x{9fff}]+$"))
    return F.concat(F.filter(plain, lambda w: F.length(w) >= 2), F.when(clear.rlike(r"[\x{4e00}-\x{9fff}]"), F.transform(chinese, lambda x: x["w"])).otherwise(F.array().cast("array<string>")))


def shares_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(extract_words(a), extract_words(b))


def matching(text: Column, keywords: list[str]) -> Column:
    """The keywords that a text holds, whatever the case, in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, F.lower(k)))


def holds_any(text: Column, keywords: list[str]) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?iu)" + "|".join(re.escape(k) for k in dict.fromkeys(k.lower() for k in keywords)))


def code_keywords(text: Column, most: int = 15) -> Column:
    """Words of code in a text, and words in Pascal case, back quotes or joined by hyphens or underscores; distinct, in order, the first ``most``."""
    named = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Z][a-z]+[A-Z][\p{L}\p{N}_]*|`[^`]+`|\b[\p{L}\p{N}_]+[-_][\p{L}\p{N}_]+\b"), 0)
    named = F.filter(F.transform(named, lambda w: F.trim(F.regexp_replace(w, "^`+|`+$", ""))), lambda w: F.length(w) > 2)
    return F.slice(F.array_sort(F.array_distinct(F.concat(matching(text, CODE_KEYWORDS), named))), 1, most)


def has_decision_signal(text: Column) -> Column:
    return F.lower(text).rlike("|".join(DECISION_SIGNALS))


def is_link_only(text: Column) -> Column:
    """A URL alone or with a comment of under three characters."""
    return strip(text).rlike(r"(?s)^https?://\S*(\s+.{0,2})?$")


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def is_only_emoji(text: Column) -> Column:
    """Emoji alone or more than four fifths of what isn't white space or a mark; a text without anything else isn't."""
    clear = F.regexp_replace(text, r"[\s.,!?，。！？、]", "")
    others = F.length(F.regexp_replace(clear, f"[{EMOJI}]", ""))
    return (F.length(clear) > 0) & (F.length(clear) - others > 0.8 * F.length(clear))


def is_mostly_emoji(text: Column) -> Column:
    """A text of one to ten characters of which more than half are emoji."""
    n = F.length(text)
    return (n > 0) & (n <= 10) & (2 * (n - F.length(F.regexp_replace(text, f"[{MOSTLY_EMOJI}]", ""))) > n)


def is_pure_question(text: Column) -> Column:
    """Ends like a question and has no word of a decision."""
    return strip(text).rlike(r"[?？吗吧么]$") & ~holds_any(text, ["决定", "确认", "通过", "用", "选"])


def is_topic_shift(text: Column) -> Column:
    """Begins like a new subject."""
    low = F.lower(strip(text))
    out = F.lit(False)
    for k in TOPIC_SHIFTS:
        out = out | F.startswith(low, F.lit(k))
    return out


def is_noise(text: Column) -> Column:
    """Whether a message says nothing: empty, emoji alone, a noise word, too short or small talk without a signal, or a bare link."""
    clear = strip(F.coalesce(text, F.lit("")))
    signal = has_decision_signal(clear)
    return (
        (clear == "")
        | is_only_emoji(clear)
        | F.lower(clear).isin(NOISE_WORDS)
        | ((F.length(clear) < MIN_LENGTH) & ~signal)
        | (F.lower(clear).rlike("|".join(NOISE_TOPICS)) & ~signal)
        | is_link_only(clear)
    )


def is_noise_for_doc(text: Column) -> Column:
    """Whether a comment on a document says nothing."""
    clear = strip(F.coalesce(text, F.lit("")))
    return (clear == "") | F.lower(clear).isin(sorted({w.lower() for w in DOC_NOISE}))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three an ellipsis where something is cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def code_fingerprint(source: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a source without white space at its lines' ends."""
    return content_hash(F.regexp_replace(source, r"[ \t]+(?=\n|$)", ""))


def memo_key(component: Column, input_hash: Column, fingerprint: Column, dependencies: Column) -> Column:
    """A key as JSON, the same whatever the order of the dependencies."""
    return F.to_json(F.struct(component.alias("component"), input_hash.alias("input_hash"), fingerprint.alias("code_fingerprint"), F.array_sort(dependencies).alias("dependencies")))


def stable_hash(*fields: Column) -> Column:
    """The SHA-256 of fields as JSON, nulls included, in the order given."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def extension(path: Column) -> Column:
    """The last extension of a path's file, lower-cased, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def language_of(path: Column) -> Column:
    """The language of a file by its extension, or an empty string."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def is_watched(path: Column, extensions: list[str]) -> Column:
    """A file of one of the extensions, not binary and in no ignored folder."""
    folders = F.split(path, "/")
    return extension(path).isin([e for e in extensions if e]) & ~is_binary(path) & ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_FOLDERS]))


def is_significant(change_type: Column, path: Column, hash_: Column, size: Column) -> Column:
    """A deletion, or a change of a text file that has a hash and over ten bytes."""
    return (change_type == "deleted") | (~is_binary(path) & (F.coalesce(hash_, F.lit("")) != "") & (size > 10))


def normalise_answer(raw: Column, keys: Column) -> Column:
    """The key that an answer gives: its beginning, else a token of it, else its first character in upper case; null for an empty one."""
    clear = F.upper(strip(F.coalesce(raw, F.lit(""))))
    begins = F.get(F.filter(keys, lambda k: F.startswith(clear, F.upper(k))), 0)
    tokens = F.split(clear, r"[^A-Z0-9]+")
    token = F.get(F.filter(keys, lambda k: F.array_contains(tokens, F.upper(k))), 0)
    return F.when(clear == "", F.lit(None).cast("string")).otherwise(F.coalesce(begins, token, F.substring(clear, 1, 1)))


def json_block(text: Column) -> Column:
    """The JSON of a model's answer: what stands in a fence, else from the first brace to the last, else the text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return strip(F.when(fenced != "", fenced).when(braces != "", braces).otherwise(text))


def epoch_time(epoch: Column) -> Column:
    """A time from seconds or, from 10**12 on, milliseconds since 1970."""
    return F.when(F.abs(epoch) >= 1e12, F.timestamp_millis(epoch.cast("long"))).otherwise(F.timestamp_micros((epoch * 1_000_000).cast("long")))


def document_type(title: Column, content: Column) -> Column:
    """The kind of a document by ordered rules over its title (or the first 100 characters), then over its first 200 characters."""
    name = F.lower(F.when(F.coalesce(title, F.lit("")) == "", F.substring(F.coalesce(content, F.lit("")), 1, 100)).otherwise(title))
    head = F.substring(F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 200)), 1, 200)
    # Words of titles, then of beginnings, in order.
    return (
        F.when(holds_any(name, ["周报", "weekly", "日报", "daily", "月报", "双周报"]), "weekly_report")
        .when(holds_any(name, ["会议", "纪要", "minutes", "meeting note"]), "meeting_notes")
        .when(holds_any(name, ["模板", "template", "模版"]), "administrative")
        .when(holds_any(name, ["方案", "设计", "架构", "技术选型", "选型"]), "design")
        .when(holds_any(name, ["规格", "spec", "需求", "requirement"]), "spec")
        .when(holds_any(name, ["决定", "决策", "decision log", "决策记录", "changelog"]), "decision_log")
        .when(holds_any(head, ["本周工作", "下周计划", "进度同步"]), "weekly_report")
        .when(holds_any(head, ["会议时间", "参会人", "议程"]), "meeting_notes")
        .when(holds_any(head, ["背景", "目标", "方案对比", "技术方案"]), "design")
        .otherwise("unknown")
    )


def blocks(content: Column) -> Column:
    """The blocks of a Markdown text: an array of (place, kind, content), cut before each line that begins with '#'.

    All but the last are headings by kind, as each ends where a heading begins.
    """
    parts = F.filter(F.split(F.coalesce(content, F.lit("")), r"(?m)(?:^|(?<=\n))(?=#)"), lambda p: p != "")
    named = lambda ps: F.transform(ps, lambda p, i: F.struct(i.alias("place"), F.when(i < F.size(ps) - 1, "heading").otherwise("content").alias("kind"), F.when(i < F.size(ps) - 1, F.regexp_replace(p, r"\n$", "")).otherwise(p).alias("content")))
    return F.get(F.transform(F.array(parts), named), 0)  # else the text is cut again for each of its blocks


def chunks(text: Column, size: int = 1024, overlap: int = 0) -> Column:
    """A text in pieces of at most ``size`` characters as an array of (place, begin, content); a shorter one stays whole."""
    clear = F.coalesce(text, F.lit(""))
    step = size - overlap
    n = F.when(F.length(clear) <= size, 1).otherwise(F.ceil((F.length(clear) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("place"), (i * step).alias("begin"), F.substring(clear, i * step + 1, F.lit(size)).alias("content")))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term of at least one character stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")
