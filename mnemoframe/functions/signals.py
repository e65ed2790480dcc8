"""Signals of a message: gates, emotions, intents, domains and query types. Column -> Column, all evaluated in the JVM.

A null message gives null or the result of no match, as each function's expression has it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions.chunks import bound

# Word lists, patterns and weights of the signals, all up to FIXED_END.
POSITIVE = ["开心", "哈哈", "牛逼", "太棒", "感谢", "谢谢", "厉害", "完美", "爽", "赞", "舒服", "终于", "happy", "great", "awesome", "thanks", "perfect", "amazing", "lol", "haha", "nice"]
NEGATIVE = ["烦", "累", "难过", "崩溃", "压力大", "压力好大", "焦虑", "郁闷", "烦死", "受不了", "头疼", "无语", "吐了", "不想干", "不想说", "心情差", "心情很差", "不想活", "难受", "annoyed", "tired", "sad", "overwhelmed", "stressed", "anxious", "frustrated", "exhausted", "depressed"]
CORRECTIONS = ["不对", "错了", "搞错", "理解错", "不是这样", "说反了", "别瞎说", "wrong", "重来", "有问题", "搞混", "弄错", "你说的不", "实际上", "mistake", "incorrect", "not right", "misunderstood", "actually", "correction"]
NO_CORRECTIONS = ["没错", "不错", "对不对", "错了吗", "是不是错", "不对称", "不对劲", "错了错了我的", "你说得对", "没有错", "not wrong", "correct", "you're right", "no mistake"]
CASUAL = ["嗯", "好", "哦", "行", "可以", "ok", "明白", "在吗", "你好", "吃了", "无聊", "哈哈", "哈哈哈", "周末", "嘿嘿", "呵呵", "hey", "hi", "hello", "yeah", "yep", "sure", "hmm", "lol", "haha", "bored", "weekend"]
TECHNICAL = (
    "代码 函数 报错 error bug crash 编译 调试 debug 实现 怎么写 算法 接口 api 变量 循环 递归 排序 数据结构 泛型 类型 python javascript typescript go golang rust java swift c++ php "
    "vue react angular node deno bun docker kubernetes k8s nginx apache linux git ci/cd jenkins redis mysql mongodb postgresql kafka rabbitmq elasticsearch 服务器 部署 deploy 容器 集群 "
    "负载均衡 微服务 grpc rest 阿里云 aws gcp 云服务 hook frida ida 逆向 加密 签名 证书 性能 优化 内存 泄漏 leak 慢查询 索引 缓存 raft 共识 分布式 并发 线程 协程 goroutine channel async await "
    "hpa rebase 多阶段构建 反向代理 数据分片"
).split()
OPINION = ["你觉得", "你看", "你认为", "你怎么看", "你的看法", "建议", "what do you think", "your opinion", "suggestion", "recommend"]
PROACTIVE = ["顺便", "另外", "还有", "对了"]
ACTION = ["做", "写", "改", "帮我", "实现", "生成", "do", "write", "change", "fix", "create", "help me"]
DOMAINS = [
    ("ios-reverse", ["frida", "hook", "ida", "mach-o", "dyld", "arm64", "objc", "逆向", "砸壳", "tweak", "substrate", "theos", "cycript", "reverse engineering", "binary analysis"], 0.95),
    ("rust", ["rust", "cargo", ".rs", "lifetime", "borrow checker"], 0.9),
    ("swift", ["swift", "xcode", "swiftui", "uikit", "cocoa", "appkit"], 0.85),
    ("golang", ["go ", "golang", "goroutine", ".go", "func "], 0.85),
    ("python", ["python", "pip", "flask", "django", "def ", "import ", ".py", "asyncio", "pandas"], 0.7),
    ("javascript", ["typescript", "javascript", "node", "react", "vue", ".ts", ".js", "npm", "pnpm", "bun"], 0.7),
    ("devops", ["docker", "k8s", "kubernetes", "nginx", "linux", "bash", "shell", "systemd", "ssh"], 0.75),
    ("database", ["sql", "mysql", "postgres", "mongodb", "数据库", "redis", "sqlite", "database", "query", "index", "schema"], 0.8),
    ("图片识别", ["图片", "ocr", "识别", "照片", "截图", "看看这个", "这张图", "image recognition", "computer vision"], 0.85),
    ("git", ["git", "github", "pr", "merge", "branch", "commit", "rebase"], 0.8),
]
ADVICE = ["怎么看", "你觉得", "建议", "应该", "推荐", "what do you think", "advice", "suggest", "recommend", "should i", "consultation"]
CHAT = ["chat", "casual", "hey", "hi ", "hello", "sup", "what's up"]
EMOJI_MOOD = {
    "😊": 0.5, "😃": 0.5, "😄": 0.5, "🙂": 0.2, "😁": 0.4, "😂": 0.4, "🤣": 0.4, "😆": 0.3, "🎉": 0.6, "🥳": 0.6, "🏆": 0.5, "❤️": 0.5, "💕": 0.4, "🥰": 0.5, "😍": 0.4, "👍": 0.3, "💪": 0.3, "✅": 0.3, "🙏": 0.3,
    "😢": -0.5, "😭": -0.6, "🥲": -0.3, "😡": -0.6, "🤬": -0.7, "😤": -0.4, "😰": -0.4, "😨": -0.5, "😱": -0.5, "😩": -0.4, "😫": -0.5, "🥺": -0.3, "💔": -0.5, "😞": -0.4, "😔": -0.4, "😐": 0.0, "🤔": 0.0, "😅": -0.1, "🫠": -0.2,
    "🔥": 0.3, "💀": -0.2, "🤡": -0.2,
}
SPECTRUM = {  # pattern over the lower-case message, weight of a hit
    "anger": ("生气|愤怒|气死|混蛋|什么鬼|太过分|凭什么|受够|垃圾|什么垃圾|angry|furious|hate|damn|wtf|bullshit", 0.3),
    "anxiety": ("焦虑|担心|害怕|紧张|不安|怎么办|来不及|deadline|ddl|赶不上|被裁|一堆bug|上线.*bug|worried|anxious|scared|nervous|panic|laid off", 0.3),
    "frustration": ("又.*了|还是不行|试了.*次|搞不定|放弃|算了|不想|太难|不适合|改了.*天|都不行|还是不对|stuck|broken|failed|give up|still not|tried .* times|can.t fix", 0.3),
    "sadness": ("难过|伤心|失望|遗憾|可惜|唉|哭|委屈|孤独|想念|分手|离职|住院|去世|走了|担心|sad|lonely|miss|crying|disappointed|heartbroken|quit|breakup", 0.35),
    "joy": ("开心|高兴|太好了|哈哈|[🎉😊😄🥳]|棒|赞|厉害|成功|心情好|心情超好|迪士尼|太棒|年终奖|太爽|好开心|happy|great|awesome|amazing|perfect|love it|so good", 0.3),
    "pride": ("搞定|做到了|完成了|(?<!要|即将|准备|快要)上线了|通过了|拿到了|star|夸了|零故障|认证|did it|success|deployed|passed|promoted|shipped|merged", 0.35),
    "relief": ("终于|解决了|松了口气|还好|幸好|好在|没事了|总算|不容易|finally|solved|fixed|got it|aha", 0.35),
    "curiosity": ("怎么.*的|为什么|好奇|想知道|有意思|原来|没想到|居然|怎么理解|帮我解释|到底怎么|生命周期|共识算法|how|why|curious|interesting|wonder|what if", 0.25),
}
INTENTS = {  # pattern in any case, weight of a hit, base without a hit
    "information": ("什么|怎么|为什么|哪个|多少|是不是|如何|区别|对比|原理|what|how|why|which|explain|difference|compare", 0.2, 0.2),
    "action": ("帮我|做|写|改|实现|生成|创建|删除|修复|部署|安装|配置|help me|do|write|change|fix|create|delete|deploy|install", 0.3, 0.0),
    "emotional": ("烦|累|难受|焦虑|开心|郁闷|崩溃|压力|害怕|纠结|迷茫|无聊|孤独|annoyed|tired|sad|anxious|happy|stressed|overwhelmed|lonely", 0.35, 0.0),
    "validation": (r"对吗|是吧|可以吗|行不行|这样[好行对]|没问题吧|对不对|right\?|correct\?|is that ok|does that work|makes sense\?", 0.4, 0.0),
    "exploration": ("有没有.*更|还有.*方法|其他|替代|更好|优化|改进|推荐|any other|alternative|better way|optimize|improve|recommend", 0.3, 0.0),
}
INJECTION = [
    r"(?i)ignore\s+(all\s+)?previous\s+instructions", "忽略(之前|上面|所有)(的)?指令", r"(?i)you\s+are\s+now\s+", r"(?i)system\s*:\s*", r"(?i)\[INST\]", "(?i)<<SYS>>",
    r"(?i)forget\s+(everything|all|your)\s+(instructions|rules|guidelines)", r"(?i)new\s+persona\s*:", r"(?i)override\s+(system|safety)",
]
TEMPORAL = r"(?i)上次|之前|以前|上周|昨天|前天|上个月|最近|那时|那年|当时|when|last|before|after|ago|first\s+time|how\s+long|since\s+when|back\s+when|at\s+what\s+point|which\s+session|what\s+time"
PRECISE = r"(?i)什么|哪个|哪里|几[个岁号]|多少|谁是|who|what|where|how\s*many"
NO_NAMES = "What When Where How Who Which Why The This That Does Did Has Have Was Were Can Could Would Should Not And But Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split()
BM25_MULTIPLIERS = {"precise": (1.5, 1.0), "temporal": (1.0, 0.67), "broad": (0.67, 0.4), "multi_entity": (0.8, 0.5)}
NEGATION = ("(?i)不擅长|不喜欢|不爱|不想|不敢|不吃|不看|不会|害怕|讨厌|恐惧|反感|忌口|don't like|afraid of|hate|bad at|can't stand", r"什么|吗|呢|哪|几|\?|？")
TRIVIAL = r"(?i)^(嗯|好的?|ok|收到|谢谢|thx|thanks|明白|懂了|了解|got it|知道了|可以|行|对|没问题|好吧)[\s。！!.]*$"
SYSTEM_PREFIXES = ["[Working Memory", "[当前面向:", "[隐私模式]", "[System]", "[安全警告]", "[元认知警告]"]
QUESTION = [
    "[？?]$", r"(.)\1不\1", "[吗呢吧嘛]$", "^.{0,6}(?:什么|哪个|哪里|谁|怎么|为什么)", "(?:叫|是|做|在|有)(?:什么|哪个|谁|怎么)", "(?:什么|哪|谁|怎么|多少|几)(?:时候|地方|样|个|种|岁|楼)",
    r"(?i)^(?:what|who|where|when|why|how|which|do you|does|did|is|are|was|were|can|could|will|would)\b", r"(?i)\b(?:what is|who is|what's my|where do i|what do i)\b",
]
ROLES = "老板|领导|boss|同事|colleague|朋友|女朋友|男朋友|老婆|老公|爸|妈|哥|姐|弟|妹|老师|客户"
FLIPS = [("喜欢|爱|偏好", "讨厌|不喜欢|不想"), ("在.*工作|在.*做", "离职|辞职|被裁"), ("住在|住", "搬到|搬去"), ("运动|跑步|健身", "不运动|不跑|放弃"), ("学|在学", "不学|放弃"), ("是|用", "不是|不用|换了")]
COMPRESSIONS = [
    (r"^(?:用户|他|她|对方)(?:说|提到|表示|告诉我|跟我说|反馈|回复|回答|补充|指出|觉得|认为|希望|想要|需要|打算|计划)\s*(?:了|过|着)?\s*(?:，|,)?\s*", ""),
    (r"(?:我觉得|我认为|我发现|我注意到|我看到|据说|好像|似乎|可能是|应该是)\s*(?:，|,)?\s*", ""),
    (r"(?:其实|事实上|实际上|说实话|老实说|总的来说|简单来说|换句话说)\s*(?:，|,)?\s*", ""),
    (r"(?:非常|特别|很|比较|相当|十分|极其|超级)\s*(?=[一-鿿])", ""),
    ("(?:的话|来说|而言|方面|这块|这个)", ""), (r"[了的呢吧啊嘛]+\s*$", ""), (r"\s{2,}", " "), ("(?:，|,){2,}", "，"),
]
SURPRISE = {
    "identity": "(?i)名字|叫我|职业|住在|工作|年龄|生日|毕业|my name|call me|i work|i live|birthday|graduated|i'm a",
    "preference": "(?i)喜欢|讨厌|偏好|习惯|最爱|受不了|i like|i love|i hate|i prefer|i enjoy|favorite|can't stand",
    "experience": r"(?i)\bi (went|did|have|had|made|took)\b",
    "outburst": "(?i)[！!]{2,}|卧槽|崩溃|太开心|难受|焦虑|omg|fuck|shit|so happy|breaking down|anxious",
    "now_zh": "今天|刚才|现在|刚刚", "now_en": "(?i)today|just now|right now|earlier today",
    "greeting": "(?i)^(你好|嗯+|好的?|谢谢|哈哈+|ok|行吧?|收到|了解|明白|可以|没问题|好吧|哦+|是的?|嗯嗯|对的?|没事|算了|随便|都行|无所谓|不用了?|知道了)$",
    "small_talk": "^.{0,15}(天气|堵车|迟到|周[一二三四五六日末]|终于.*休息|几点了|现在几点|路上)",
}
# FIXED_END


def hits(message: Column, words: list[str]) -> Column:
    """How many of the words the message contains."""
    return reduce(lambda a, b: a + b, [F.contains(message, F.lit(w)).cast("int") for w in words])


def any_of(message: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(message, F.lit(w)) for w in words])


def any_pattern(message: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [message.rlike(p) for p in patterns])


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def emoji_mood(message: Column) -> Column:
    """Mean mood of the kinds of emoji in the message, null without any."""
    n = hits(message, list(EMOJI_MOOD))
    total = reduce(lambda a, b: a + b, [F.contains(message, F.lit(e)).cast("int") * mood for e, mood in EMOJI_MOOD.items()])
    return F.when(n > 0, total / n)


def emotion_spectrum(message: Column) -> dict[str, Column]:
    """Strengths from 0 to 1 of eight emotions that may stand together."""
    low = F.lower(message)
    n = {k: F.regexp_count(low, F.lit(p)) for k, (p, _) in SPECTRUM.items()}
    out = {k: F.least(F.lit(1.0), n[k] * w) for k, (_, w) in SPECTRUM.items()}
    out["anger"] = F.when(message.rlike("[！!]{2,}") & (n["anger"] > 0), F.least(F.lit(1.0), 0.5 + 0.2 * n["anger"])).otherwise(out["anger"])
    out["joy"] = F.when(low.rlike("太好了|跑通了"), F.least(F.lit(1.0), out["joy"] + 0.2)).otherwise(out["joy"])
    mood = F.coalesce(emoji_mood(message), F.lit(0.0))
    out["joy"] = out["joy"] + 0.5 * F.greatest(mood, F.lit(0.0))
    out["sadness"] = out["sadness"] + 0.3 * F.greatest(-mood, F.lit(0.0))
    out["frustration"] = out["frustration"] + 0.2 * F.greatest(-mood, F.lit(0.0))
    return {k: _unit(v) for k, v in out.items()}


def dominant(spectrum: dict[str, Column], least: float = 0.15) -> Column:
    """The strongest emotion over ``least``, the first named of equals, or null."""
    top = F.greatest(*spectrum.values())
    return F.when(top > least, F.coalesce(*[F.when(v == top, k) for k, v in spectrum.items()]))


def quick_class(message: Column) -> Column:
    low = F.lower(message)
    technical, emotional = hits(low, TECHNICAL), hits(low, NEGATIVE + POSITIVE)
    casual = low.isin(*CASUAL, *[w + "的" for w in CASUAL])
    size = F.length(message)
    return F.when((technical >= 2) | ((technical >= 1) & (size > 30)), "technical").when(emotional >= 2, "emotional").when((casual & (size < 15)) | (size < 8), "casual").otherwise("general")


def attention(message: Column) -> tuple[Column, Column]:
    """(type, priority from 1 to 10): the hypothesis with most evidence, the first named of equals, and its softmax share."""
    low, size = F.lower(message), F.length(message)
    technical = hits(low, TECHNICAL)
    casual = low.isin(*CASUAL).cast("int") + low.isin(*[w + "的" for w in CASUAL]).cast("int")
    scores = {
        "correction": F.when(any_of(low, NO_CORRECTIONS), 0.0).otherwise(3.0 * hits(low, CORRECTIONS)),
        "emotional": 2.0 * hits(low, NEGATIVE + POSITIVE) + F.when((hits(low, NEGATIVE) > 0) & (technical > 0), 1.0).otherwise(0.0),
        "technical": 2.0 * technical + F.when(size > 100, 0.5).otherwise(0.0),
        "casual": 2.0 * casual + F.when(size < 15, 1.0).otherwise(0.0) + F.when(size < 8, 1.0).otherwise(0.0),
        "general": F.lit(1.0),
    }
    top = F.greatest(*scores.values())
    share = 1 / reduce(lambda a, b: a + b, [F.exp(2 * (s - top)) for s in scores.values()])
    return F.coalesce(*[F.when(s == top, k) for k, s in scores.items()]), F.least(F.lit(10), F.greatest(F.lit(1), F.floor(10 * share + 0.5))).cast("int")


def intent(message: Column) -> Column:
    low = F.lower(message)
    asks = low.rlike("[?？吗呢么]$")
    return F.when(any_of(low, OPINION), "wants_opinion").when(any_of(low, PROACTIVE), "wants_proactive").when(asks, "wants_answer").when(F.length(message) < 20, "wants_quick").when(any_of(low, ACTION), "wants_action").otherwise("unclear")


def strategy(attention_type: Column, wanted: Column, message: Column) -> Column:
    size = F.length(message)
    return (
        F.when(attention_type == "correction", "acknowledge_and_retry").when(attention_type == "emotional", "empathy_first").when((wanted == "wants_quick") | (size < 10), "direct")
        .when(wanted == "wants_opinion", "opinion_with_reasoning").when(wanted == "wants_action", "action_oriented").when(size > 200, "detailed").otherwise("balanced")
    )


def intent_spectrum(message: Column) -> dict[str, Column]:
    size = F.length(message)
    out = {k: F.least(F.lit(1.0), base + w * F.regexp_count(message, F.lit("(?i)" + p))) for k, (p, w, base) in INTENTS.items()}
    for k, long, short in (("information", 1.2, 1.0), ("action", 1.1, 1.0), ("emotional", 1.0, 1.3), ("validation", 1.0, 1.2)):
        out[k] = out[k] * F.when(size > 100, long).when(size < 15, short).otherwise(1.0)
    return {k: _unit(v) for k, v in out.items()}


def domain(message: Column) -> Column:
    """The domain with most hits times specificity, the first named of equals; short or chatty messages are 闲聊, others 通用."""
    low, size = F.lower(message), F.length(message)
    scores = [(name, hits(low, words) * weight) for name, words, weight in DOMAINS]
    top = F.greatest(*[s for _, s in scores])
    best = F.coalesce(*[F.when(s == top, name) for name, s in scores])
    return F.when(top > 0, best).when(size < 20, "闲聊").when(any_of(low, ADVICE), "咨询").when(any_of(low, CHAT) & (size < 30), "闲聊").otherwise("通用")


def mentioned_people(message: Column) -> Column:
    """Distinct role words, then names of the form 小李."""
    return F.array_distinct(F.concat(F.regexp_extract_all(message, F.lit(f"({ROLES})"), F.lit(1)), F.regexp_extract_all(message, F.lit("([小大老][A-Z一-鿿])"), F.lit(1))))


def injection(message: Column) -> Column:
    return any_pattern(message, INJECTION)


def worth_saving(content: Column, scope: Column) -> Column:
    """Not a bare acknowledgement or under five characters, unless a correction or preference; no system text."""
    short = F.trim(content)
    trivial = (short.rlike(TRIVIAL) | short.rlike("^.{0,4}$")) & ~scope.isin("correction", "preference")
    return ~trivial & ~any_of(content, SYSTEM_PREFIXES)


def surprise(content: Column, scope: Column) -> Column:
    """How much news a content holds, from 1 to 10."""
    p = {k: content.rlike(v) for k, v in SURPRISE.items() if k != "greeting"}
    size = F.length(content)
    base = F.when(p["preference"], 7).when(p["identity"], 9).otherwise(5)
    base = F.when(scope == "correction", 8).otherwise(F.when(p["experience"], F.greatest(base, F.lit(4))).otherwise(base))
    base = base + p["outburst"].cast("int") * 2 - p["now_zh"].cast("int") * 2 - p["now_en"].cast("int")
    base = F.when(F.trim(content).rlike(SURPRISE["greeting"]), 1).otherwise(base)
    base = F.when(p["small_talk"] & (size < 25), F.least(base, F.lit(2))).otherwise(base) - (size < 10).cast("int")
    base = F.when((size <= 4) & ~content.rlike("[a-zA-Z]{3,}"), 1).otherwise(base)
    return F.greatest(F.lit(1), F.least(F.lit(10), base))


def is_question(content: Column) -> Column:
    return any_pattern(F.trim(content), QUESTION)


def query_type(query: Column) -> Column:
    """temporal, multi_entity (two capitalised names or more), precise or broad."""
    names = F.filter(F.regexp_extract_all(query, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,})(?![A-Za-z0-9_])"), F.lit(1)), lambda w: ~w.isin(*NO_NAMES))
    return F.when(query.rlike(TEMPORAL), "temporal").when(F.size(names) >= 2, "multi_entity").when(query.rlike(PRECISE), "precise").otherwise("broad")


def bm25_parameters(query: Column, k1: float = 1.2, b: float = 0.75) -> tuple[Column, Column]:
    """k1 and b for the type of the query; without a CJK character k1 is larger and b smaller."""
    kind = query_type(query)
    by = lambda k: F.when(kind == "precise", BM25_MULTIPLIERS["precise"][k]).when(kind == "temporal", BM25_MULTIPLIERS["temporal"][k]).when(kind == "multi_entity", BM25_MULTIPLIERS["multi_entity"][k]).otherwise(BM25_MULTIPLIERS["broad"][k])
    cjk = query.rlike("[一-鿿]")
    return k1 * by(0) * F.when(cjk, 1.0).otherwise(1.25), b * by(1) * F.when(cjk, 1.0).otherwise(0.67)


def time_range(query: Column) -> Column:
    """(from_day, to_day) as days before now that a query names, null without any."""
    days = F.regexp_extract(query, r"(?i)(\d+)\s*(?:天前|days?\s*ago)", 1)
    weeks = F.regexp_extract(query, r"(?i)(\d+)\s*(?:周前|weeks?\s*ago)", 1)
    span = lambda a, b: F.struct(F.lit(a).cast("int").alias("from_day"), F.lit(b).cast("int").alias("to_day"))
    around = lambda n, unit: F.struct((-(n.cast("int") + 1) * unit).alias("from_day"), (-F.greatest(F.lit(0), n.cast("int") - 1) * unit).alias("to_day"))
    return (
        F.when(query.rlike("(?i)昨天|yesterday"), span(-2, -1)).when(query.rlike("前天"), span(-3, -2)).when(query.rlike("(?i)上周|last week"), span(-14, -7)).when(query.rlike("(?i)上个月|last month"), span(-60, -30))
        .when(query.rlike("(?i)最近|recently"), span(-7, 0)).when(query.rlike("(?i)今天|today"), span(-1, 0)).when(query.rlike("(?i)明天|tomorrow"), span(0, 1)).when(days != "", around(days, 1)).when(weeks != "", around(weeks, 7))
    )


def negation_query(query: Column) -> Column:
    return query.rlike(NEGATION[0]) & query.rlike(NEGATION[1])


def polarity_flip(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x | y, [(a.rlike(p) & b.rlike(q)) | (a.rlike(q) & b.rlike(p)) for p, q in FLIPS])


def compressed(content: Column) -> Column:
    """A text of over 30 characters without filler words; as it was if fewer than five characters stay."""
    whole = F.regexp_replace(content, r"^\s+|\s+$", "")
    out = whole
    for pattern, by in COMPRESSIONS:
        out = F.regexp_replace(out, pattern, by)
    out = F.regexp_replace(F.regexp_replace(out, r"^[，,、。：:；;\s]+", ""), r"[，,、。：:；;\s]+$", "")
    return F.when((F.length(whole) <= 30) | (F.length(out) < 5), whole).otherwise(out)


def reply_entropy(reply: Column, before: Column) -> Column:
    """Half the Shannon entropy of the reply's characters and half the share of its words that the message before lacks."""
    words = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("(?i)([一-鿿]{2,}|[a-z]{3,})"), F.lit(1)), F.lower))
    own = words(reply)
    novelty = F.when(F.size(own) > 0, F.size(F.array_except(own, words(before))) / F.size(own)).otherwise(0.0)
    n = F.length(reply)
    chars = F.split(reply, "")
    # equal characters stand together once sorted: runs give the counts in one pass
    sums = F.aggregate(
        F.array_sort(chars), F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0.0).alias("s")),
        lambda acc, c: F.struct(c.alias("c"), F.when(acc["c"] == c, acc["k"] + 1).otherwise(1).alias("k"), F.when((acc["c"] == c) | (acc["k"] == 0), acc["s"]).otherwise(acc["s"] + acc["k"] * F.log2(acc["k"].cast("double"))).alias("s")),
        lambda acc: F.when(acc["k"] > 0, acc["s"] + acc["k"] * F.log2(acc["k"].cast("double"))).otherwise(0.0),
    )
    return F.when(n < 2, 0.0).otherwise(0.5 * (F.log2(n.cast("double")) - sums / n) + 0.5 * novelty)


def stem(word: Column) -> Column:
    """A light suffix stemmer for English: one plural, one participle and one common suffix."""
    cut = lambda x, k: F.substring(x, F.lit(1), F.length(x) - k)

    def plural(w: Column) -> Column:
        return F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(cut(w, 3), F.lit("i"))).when(w.endswith("sses"), cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us"), cut(w, 1)).otherwise(w)

    def participle(w: Column) -> Column:
        return F.when(w.endswith("eed"), w).when(w.endswith("ed") & (F.length(w) > 4), cut(w, 2)).when(w.endswith("ing") & (F.length(w) > 5), cut(w, 3)).otherwise(w)

    def suffix(w: Column) -> Column:
        out = F.when(w.endswith("tion"), F.concat(cut(w, 4), F.lit("t")))
        for end, least in (("ness", 5), ("ment", 5), ("ful", 5), ("ous", 5), ("ive", 5), ("able", 6), ("ible", 6)):
            out = out.when(w.endswith(end) & (F.length(w) > least), cut(w, len(end)))
        return out.when(w.endswith("ally") & (F.length(w) > 6), F.concat(cut(w, 4), F.lit("al"))).when(w.endswith("ly") & (F.length(w) > 4), cut(w, 2)).otherwise(w)

    # each step's value is bound once, so the expression grows with the number of rules, not with their product
    return F.when(F.length(word) < 4, word).otherwise(bound(F.lower(word), lambda w: bound(plural(w), lambda x: bound(participle(x), suffix))))
