"""A rule-based score of how much a text reads like a decision, wholly as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import is_mostly_emoji, is_pure_question, strip

# Words of a signal and its weight.
LEXICAL = [
    (["决定", "已决定", "决定了", "最终决定"], 1.0),
    (["确认", "已确认", "确认了", "确认一下"], 0.9),
    (["通过", "已通过", "通过了", "审批通过"], 0.9),
    (["定下来", "就这样", "就这么办", "定了"], 0.95),
    (["结论", "最终结论", "结论是"], 0.9),
    (["不再讨论", "不讨论", "到此为止"], 0.85),
    (["采用", "选用", "使用", "用这个"], 0.65),
    (["选", "选择", "选型", "方案", "技术栈", "开发语言", "语言"], 0.55),
    (["建议", "推荐", "提议"], 0.50),
    (["approve", "lgtm", "LGTM", "approved", "confirmed", "agreed"], 0.70),
    (["decided", "decision", "finalize"], 0.75),
    (["需要", "必须", "务必", "一定要", "尽快"], 0.50),
    (["暂不", "不采用", "否决", "驳回", "不同意"], 0.60),
    (["todo", "to do", "action item", "待办"], 0.55),
    (["责任人", "负责", "执行人", "owner"], 0.50),
    (["可以", "没问题", "ok", "OK", "好的"], 0.20),
    (["对比", "比较", "vs", "还是", "或者", "alternative"], 0.35),
    (["我觉", "我认为", "个人认为", "观点"], 0.25),
    (["计划", "安排", "排期", "时间"], 0.30),
    (["问题", "bug", "issue", "修复"], 0.30),
]
LISTS, OPTIONS = ["1.", "2.", "3.", "第一", "第二", "第三", "首先", "其次", "最后"], ["/", "vs", "VS", "对比"]
TECHNICAL = ["接口", "API", "数据库", "服务", "部署", "架构", "前端", "后端", "客户端", "协议", "格式", "版本"]
ASSIGNMENTS = ["来负责", "来处", "来做", "由你", "由我", "由他", "assign", "负责", "owner"]
# Patterns of a signal and its weight, for messages and for documents.
PATTERNS = [
    (r"(采用|选用|使用|用)\s*[，,。.\s]*(方案|方式|方法|技术|框架|工具)", 0.75),
    (r"就[用定选]", 0.70),
    (r"(决定|确认|同意)\s*(使用|采用|用|选|选择)", 0.80),
    (r"(最终|最后)[的决定的方案]", 0.50),
    (r"(可以|没问题|ok|好的|行)[，,。.．！!\s]*(就|按|照|这样)", 0.45),
    (r"(同意|批准|通过|approve)\s*(这个|该|此)", 0.80),
    (r"(倾向于|偏向|建议|推荐)\s*(使用|采用|选|用)", 0.60),
    (r"我\s*(建议|推荐|觉得)\s*[我们]?\s*[采用使用选用]", 0.55),
    (r"(因此|所以|那[就么]|那就)", 0.30),
    (r"总结[一下]?[：:,，]", 0.65),
    (r"结论[是就]", 0.75),
    (r"(由|让|请)\s*[@]?\S{1,10}[来去]\s*(负责|处理|跟进|做|完成)", 0.55),
    (r"([\x{4e00}-\x{9fff}\p{L}\p{N}_]{2,10})\s*(负责|owner|owner是)", 0.50),
    (r"(用|选|采用)\s*\S{1,10}\s*(还是|或|or|vs)\s*\S{1,10}", 0.45),
    (r"(不|别|不用|不需要|没必要)\s*(考虑|使用|采用|选)", 0.55),
    (r"(否决|驳回|不同意|反对)\s*(这个|该|此)", 0.75),
    (r"(我反对|我不同意|持保留意见|有异议|不认同)", 0.80),
    (r"(应该用|不如用|建议用|推荐用|换成|改用)\s*\S+\s*(代替|替代|而不是|而非)", 0.70),
    (r"(不同意|反对|不认可).{2,20}(因为|原因是|理由|风险|问题)", 0.85),
    (r"(这个决定|这个方案|这个选择).{0,10}(有问题|不合适|不对|不好|不行)", 0.75),
    (r"(截止|之前|前|ddl|deadline)\s*[：:为]?\s*\d{1,2}[月/.]", 0.40),
    (r"(投票|表决|举手表决|投票决定|投票结果)", 0.70),
]
DOC_PATTERNS = [
    (r"(采用|选用|使用|用)\s*[，,。.\s]*(方案|方式|方法|技术|框架|工具)", 0.75),
    (r"(决定|确认|同意)\s*(使用|采用|用|选|选择)", 0.80),
    (r"结论[是就]", 0.75),
    (r"(同意|批准|通过)\s*(这个|该|此)", 0.80),
    (r"(不|别|不用|不需要|没必要)\s*(考虑|使用|采用|选)", 0.55),
    (r"#+\s*(决定|结论|决策|方案选择|技术选型)", 0.80),
    (r"#+\s*(架构|设计|方案|技术方案)", 0.65),
    (r"#+\s*(理由|原因|依据|考量|权衡|对比)", 0.55),
    (r"(优点|缺点|优势|劣势|Pros|Cons|好处|坏处)", 0.55),
    (r"(方案[一二三123ABC]|Option\s*[ABC]|对比项)", 0.50),
    (r"(技术选型|框架选择|工具选择|数据库选型)", 0.80),
    (r"(最终推荐|推荐方案|建议方案|最终选择)", 0.85),
    (r"(技术栈|使用|采用|选用)[：:]\s*\S+", 0.75),
    (r"(使用|采用|选用|选择)\s*(Gin|React|Vue|Go|Python|Java|MySQL|PostgreSQL|Redis|MongoDB|Kubernetes|Docker)", 0.80),
]
# Words of which a text holds one if it matches the pattern at the same place of PATTERNS and of DOC_PATTERNS.
PATTERN_WORDS = [
    ["方案", "方式", "方法", "技术", "框架", "工具"],
    ["就"],
    ["决定", "确认", "同意"],
    ["最终", "最后"],
    ["就", "按", "照", "这样"],
    ["这个", "该", "此"],
    ["倾向于", "偏向", "建议", "推荐"],
    ["我"],
    ["因此", "所以", "那"],
    ["总结"],
    ["结论"],
    ["负责", "处理", "跟进", "做", "完成"],
    ["负责", "owner"],
    ["用", "选"],
    ["考虑", "使用", "采用", "选"],
    ["否决", "驳回", "不同意", "反对"],
    ["我反对", "我不同意", "持保留意见", "有异议", "不认同"],
    ["代替", "替代", "而不是", "而非"],
    ["不同意", "反对", "不认可"],
    ["这个决定", "这个方案", "这个选择"],
    ["截止", "前", "ddl", "deadline"],
    ["投票", "表决"],
]
DOC_PATTERN_WORDS = [
    ["方案", "方式", "方法", "技术", "框架", "工具"],
    ["决定", "确认", "同意"],
    ["结论"],
    ["同意", "批准", "通过"],
    ["考虑", "使用", "采用", "选"],
    ["决定", "结论", "决策", "方案选择", "技术选型"],
    ["架构", "设计", "方案"],
    ["理由", "原因", "依据", "考量", "权衡", "对比"],
    ["优点", "缺点", "优势", "劣势", "Pros", "Cons", "好处", "坏处"],
    ["方案", "Option", "对比项"],
    ["技术选型", "框架选择", "工具选择", "数据库选型"],
    ["最终推荐", "推荐方案", "建议方案", "最终选择"],
    ["技术栈", "使用", "采用", "选用"],
    ["使用", "采用", "选用", "选择"],
]
# Words that speak against a decision, and their weight.
AGAINST = [
    (["早上好", "下午好", "晚上好", "大家好", "hello", "hi ", "hey", "辛苦了", "谢谢", "感谢", "拜拜", "再见", "see you"], 0.3),
    (["可能", "也许", "大概", "或许", "不一定", "maybe", "perhaps", "probably", "not sure", "再看看", "再想想", "考虑一下", "讨论一下", "再说", "以后再说"], 0.4),
    (["已完成", "正在处理", "进度", "进展", "更新一下", "update", "完工", "当前状态", "目前"], 0.5),
    (["分享", "通知", "告知", "FYI", "fyi", "仅供参考", "参考"], 0.4),
    (["打算", "想试试", "准备做", "计划做", "考虑使用", "考虑采用"], 0.3),
    (["他说", "她说", "反馈说", "提到", "提及"], 0.35),
]
SMALL_TALK = ["吃", "喝", "玩", "天气", "八卦"]
DOC_SIGNALS = ["技术栈", "框架", "选用", "使用", "采用", "决定", "选择", "方案", "选型", "架构", "Gin", "React", "Vue", "Go", "Python", "Java", "MySQL", "PostgreSQL", "Redis", "MongoDB"]
MINOR_EDITS, OPEN_POINTS = ["fix typo", "format", "格式", "错别字", "排版"], ["TODO", "FIXME", "待完成", "待办"]


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _category(signals: list[tuple[Column, float]]) -> Column:
    """The highest weight of the signals that hold, a tenth more from three on, 1 at most. Each signal is looked at once."""

    def weighed(held: Column) -> Column:
        most = F.greatest(F.lit(0.0), *[F.when(F.get(held, k), F.lit(w)).otherwise(F.lit(0.0)) for k, (_, w) in enumerate(signals)])
        return F.least(F.lit(1.0), most + F.when(F.size(F.filter(held, lambda t: t)) >= 3, 0.1).otherwise(0.0))

    return _once(F.array(*[t for t, _ in signals]), weighed)


#: Characters before those of CJK, and whether a word holds none of them.
NARROW = r"[\x{0}-\x{2e7f}]"
_is_wide = lambda w: all(c > "\u2e7f" for c in w)


def wide(text: Column) -> Column:
    """What a text has from CJK's characters on, a space between what others part: few characters of most texts, so that looking for many words costs little."""
    return F.regexp_replace(text, f"{NARROW}+", " ")


def _finds(text: Column, broad: Column, words: list[str]) -> Column:
    """Whether a text holds one of some words; ``broad`` is its ``wide``, where words of such characters are looked for."""
    known = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    one_of = lambda t, ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(t, w))
    parts = [(broad, [w for w in known if _is_wide(w)]), (text, [w for w in known if not _is_wide(w)])]
    return reduce(lambda a, b: a | b, [one_of(t, ws) for t, ws in parts if ws])


def _holds(low: Column, broad: Column, words: list[str]) -> Column:
    """Whether a lower-cased text holds one of some words, whatever their case."""
    return _finds(low, broad, [w.lower() for w in words])


def lexical(low: Column, broad: Column) -> Column:
    return _category([(_holds(low, broad, words), w) for words, w in LEXICAL])


def structural(text: Column, low: Column, broad: Column) -> Column:
    technical = (F.length(text) > 50) & _holds(low, broad, TECHNICAL)
    return _category([(_holds(low, broad, LISTS), 0.40), (_holds(low, broad, OPTIONS), 0.35), (_finds(text, broad, ['"', "「", "『"]), 0.20), (technical, 0.35), (_holds(low, broad, ASSIGNMENTS), 0.45)])


def dynamic(low: Column, is_reply: Column, has_mention: Column, index: Column, recent: Column) -> Column:
    """What the place of a message in its conversation says: ``recent`` are words of the messages before."""
    goes_on = F.size(F.filter(F.coalesce(recent, F.array().cast("array<string>")), lambda k: F.contains(low, F.lower(k)))) >= 2
    return _category([(F.coalesce(is_reply, F.lit(False)), 0.35), (F.coalesce(has_mention, F.lit(False)), 0.40), (F.coalesce(index, F.lit(0)) > 2, 0.25), (goes_on, 0.30)])


def patterns(text: Column, broad: Column, table: list[tuple[str, float]] = PATTERNS, words: list[list[str]] = PATTERN_WORDS) -> Column:
    """A pattern is tried only on texts that hold one of its words."""
    return _category([(_finds(text, broad, ws) & text.rlike(p), w) for (p, w), ws in zip(table, words, strict=True)])


def anti_score(text: Column, low: Column, broad: Column) -> Column:
    """How much speaks against a decision, 1 at most."""
    parts = [F.when(_holds(low, broad, words), w).otherwise(0.0) for words, w in AGAINST]
    parts += [F.when(is_mostly_emoji(text), 0.5).otherwise(0.0), F.when(is_pure_question(text), 0.3).otherwise(0.0)]
    parts.append(F.when((F.length(text) < 20) & _holds(low, broad, SMALL_TALK), 0.5).otherwise(0.0))
    return F.least(F.lit(1.0), F.round(reduce(lambda a, b: a + b, parts), 9))


def _levels(score: Column, high: float, medium: float, low: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("none")


def _result(text: Column, stopped: Column, score: Column, levels: tuple[float, float, float], anti: Column) -> Column:
    stopped = (text == "") | stopped
    score = F.when(stopped, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9))
    level = F.when(stopped, F.lit("none")).otherwise(_levels(score, *levels))
    return F.struct(score.alias("score"), level.alias("level"), level.isin("high", "medium").alias("is_decision"), anti.alias("anti_score"))


def _lowered(content: Column, **more: Column) -> Column:
    """A struct of the stripped text, the same in lower case, what is wide of that, and ``more``."""
    own = F.struct(strip(F.coalesce(content, F.lit(""))).alias("text"), *[c.alias(k) for k, c in more.items()])
    both = _once(own, lambda x: F.struct(F.lower(x["text"]).alias("low"), *[x[k].alias(k) for k in ("text", *more)]))
    return _once(both, lambda x: F.struct(wide(x["low"]).alias("broad"), *[x[k].alias(k) for k in ("text", "low", *more)]))


def detect_message(content: Column, is_reply: Column | None = None, has_mention: Column | None = None, index: Column | None = None, recent: Column | None = None) -> Column:
    """(score, level, is_decision, anti_score) of a message."""
    given = {"is_reply": is_reply, "has_mention": has_mention, "index": index, "recent": recent}
    kinds = {"is_reply": "boolean", "has_mention": "boolean", "index": "int", "recent": "array<string>"}
    context = {k: (c if c is not None else F.lit(None)).cast(kinds[k]) for k, c in given.items()}

    def parts(x: Column) -> Column:
        text, low, broad = x["text"], x["low"], x["broad"]
        dyn = dynamic(low, x["is_reply"], x["has_mention"], x["index"], x["recent"])
        return F.struct(text.alias("text"), lexical(low, broad).alias("lex"), structural(text, low, broad).alias("struct"), dyn.alias("dyn"), patterns(text, broad).alias("pat"), anti_score(text, low, broad).alias("anti"))

    def judged(p: Column) -> Column:
        score = 0.45 * p["lex"] + 0.15 * p["struct"] + 0.05 * p["dyn"] + 0.35 * p["pat"]
        score = F.when((p["pat"] >= 0.7) & (score < p["pat"]), (score + p["pat"]) / 2).otherwise(score)
        return _result(p["text"], p["anti"] >= 0.6, score * (1 - 0.5 * p["anti"]), (0.65, 0.50, 0.20), p["anti"])

    return _once(_once(_lowered(content, **context), parts), judged)


def detect_document(content: Column, doc_type: Column) -> Column:
    """(score, level, is_decision, anti_score) of a document of a kind."""

    def parts(x: Column) -> Column:
        text, low, broad = x["text"], x["low"], x["broad"]
        short = (F.length(text) < 50) & ~_holds(low, broad, DOC_SIGNALS)
        tests = [x["kind"] == "weekly_report", x["kind"] == "meeting_notes", x["kind"] == "administrative", short, _holds(low, broad, MINOR_EDITS), _holds(low, broad, OPEN_POINTS)]
        anti = F.least(F.lit(1.0), F.round(reduce(lambda a, b: a + b, [F.when(t, 0.2).otherwise(0.0) for t in tests]), 9))
        return F.struct(text.alias("text"), x["kind"].alias("kind"), lexical(low, broad).alias("lex"), structural(text, low, broad).alias("struct"), patterns(text, broad, DOC_PATTERNS, DOC_PATTERN_WORDS).alias("pat"), anti.alias("anti"))

    def judged(p: Column) -> Column:
        score = (0.40 * p["lex"] + 0.20 * p["struct"] + 0.35 * p["pat"]) * (1 - 0.2 * p["anti"])
        return _result(p["text"], (p["anti"] >= 0.6) | p["kind"].isin("weekly_report", "administrative"), score, (0.45, 0.30, 0.15), p["anti"])

    return _once(_once(_lowered(content, kind=F.coalesce(doc_type, F.lit("unknown"))), parts), judged)
