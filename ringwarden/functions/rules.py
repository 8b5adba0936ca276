"""Explainable indicators of fraud in Vietnamese call transcripts.

A transcript is cut into clauses (rows with an array of words).  A lexicon names
kinds of phrases; where they stand in a clause is an array beside its words.  A rule
is a row too: kinds that follow each other within so many words.  Rules meet
clauses by their first kind, each further kind is looked for among the clause's places,
guards are expressions over the words around a hit.  Hits are merged by groupBy: the highest
severity of an indicator, up to three pieces of evidence, the rules' names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwarden.functions.transcripts import normalised
from ringwarden.staging import Staging

#: Indicator codes in the order of reports.
CODES = ["OTP_REQUEST", "MONEY_TRANSFER", "BANK_IMPERSONATION", "AUTHORITY_IMPERSONATION", "URGENCY", "ACCOUNT_LOCK_THREAT", "SENSITIVE_INFORMATION",
         "LEGAL_THREAT", "HARM_THREAT", "SECRECY_DEMAND", "REMOTE_ACCESS_REQUEST", "FINANCIAL_BAIT", "UNUSUAL_PAYMENT", "CALL_HANDOFF", "COORDINATED_CALLERS"]
#: Codes that put pressure on the person called.
PRESSING = ["OTP_REQUEST", "MONEY_TRANSFER", "BANK_IMPERSONATION", "AUTHORITY_IMPERSONATION", "ACCOUNT_LOCK_THREAT", "LEGAL_THREAT", "HARM_THREAT",
            "SECRECY_DEMAND", "REMOTE_ACCESS_REQUEST", "UNUSUAL_PAYMENT"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH"]
MOST_EVIDENCE = 3
#: Words of the longest phrase of the lexicon.
LONGEST = 4

#: Kinds of phrases, in everyday Vietnamese, with tone marks where the normal form puts them.
LEXICON = {
    "speaker": ["tôi", "em", "mình", "bên em", "bên tôi", "bên này", "chúng tôi", "chúng em", "đây là"],
    "calls from": ["gọi từ", "gọi đến từ", "là nhân viên", "nhân viên", "bên"],
    "officer of": ["gọi từ", "là cán bộ", "là điều tra viên", "bên"],
    "bank": ["ngân hàng", "tổng đài ngân hàng", "vietcombank", "techcombank", "agribank", "bidv", "vietinbank", "acb", "sacombank"],
    "staff": ["là nhân viên", "là chuyên viên", "là cán bộ"],
    "bank desk": ["đây là tổng đài", "đây là phòng thẻ"],
    "police": ["công an", "cảnh sát", "viện kiểm sát", "tòa án", "cục thuế", "cơ quan điều tra"],
    "give": ["đọc", "cho", "gửi", "cung cấp", "nhắn", "báo", "nói", "đưa", "xác nhận"],
    "code": ["otp", "mã otp", "mã xác thực", "mã xác nhận", "mã bảo mật", "mã code", "ô tê pê", "o t p"],
    "fresh code": ["mã vừa gửi", "mã vừa về", "một mã", "mã sáu số"],
    "to me": ["cho em", "cho tôi", "cho cháu", "cho mình", "cho bên em", "cho chúng tôi", "giúp em", "giúp tôi", "giúp cháu"],
    "read out": ["đọc", "đọc lại", "báo", "báo lại", "nhắn", "nhắn lại"],
    "type in": ["nhập"],
    "page": ["vào đường link", "vào link", "vào trang"],
    "password": ["mật khẩu", "mã pin", "số thẻ", "mã cvv", "tên đăng nhập"],
    "papers": ["căn cước", "số căn cước", "chứng minh nhân dân", "cccd", "số cccd"],
    "account number": ["số tài khoản"],
    "must": ["phải", "cần", "hãy", "yêu cầu", "vui lòng"],
    "pay": ["chuyển tiền", "chuyển khoản", "nộp tiền", "thanh toán", "đóng tiền", "nạp tiền", "gửi tiền"],
    "now": ["ngay", "ngay lập tức", "lập tức", "gấp", "khẩn cấp", "trong hôm nay", "luôn bây giờ"],
    "do": ["làm", "xử lý", "thực hiện", "bấm", "cài"],
    "holding account": ["tài khoản tạm giữ", "tài khoản an toàn", "tài khoản kiểm tra"],
    "account": ["tài khoản", "thẻ", "sim", "số điện thoại"],
    "be": ["sẽ bị", "sắp bị", "bị", "sẽ không bị", "không bị", "chưa bị"],
    "locked": ["khóa", "phong tỏa", "đóng băng", "cắt"],
    "photograph": ["chụp", "chụp ảnh", "quay"],
    "bank card": ["thẻ ngân hàng", "thẻ atm", "thẻ tín dụng", "thẻ visa"],
    "send": ["gửi"],
    "digits on": ["số trên", "từng số trên", "dãy số trên"],
    "film": ["quay video", "quay phim", "quay clip"],
    "face": ["khuôn mặt", "gương mặt"],
    "let me know": ["cho cháu biết", "cho em biết", "cho tôi biết", "kê khai", "khai báo"],
    "holdings": ["còn bao nhiêu tiền", "có bao nhiêu tiền", "số dư"],
    "bank sign-in": ["đăng nhập ngân hàng", "nhập tài khoản"],
    "move": ["chuyển", "nộp", "gửi"],
    "sum": ["triệu", "nghìn", "tỷ", "toàn bộ tiền", "toàn bộ số tiền"],
    "into": ["vào tài khoản", "sang tài khoản", "qua tài khoản"],
    "of theirs": ["của cán bộ", "của thầy", "của chúng tôi", "của bên em", "ký qũy", "tạm giữ", "an toàn"],
    "unless": ["nếu không", "nếu anh không", "nếu chị không", "nếu bác không"],
    "within": ["trong vòng", "trong"],
    "time": ["phút", "giờ", "tiếng"],
    "or none": ["kẻo hết suất", "kẻo hết hạn", "sắp hết suất"],
    "between us": ["việc này kín", "chuyện này kín", "giữ kín chuyện này", "giữ kín việc này"],
    "speak out": ["nói ra", "kể ra", "để lộ"],
    "send people": ["cho người đến", "cho người tới", "cho người qua"],
    "house": ["nhà", "tận nhà"],
    "pictures": ["gửi hình", "gửi ảnh", "gửi clip"],
    "contacts": ["hết danh bạ", "cả danh bạ", "toàn bộ danh bạ"],
    "leak": ["tung ảnh", "tung clip", "tung video", "tung hình"],
    "give back": ["chuyển lại", "nhận lại", "hoàn lại"],
    "twice": ["gấp đôi", "gấp ba"],
    "top up": ["nạp tiền"],
    "as told": ["theo hướng dẫn"],
    "prosecution": ["lệnh bắt", "khởi tố", "truy tố", "lệnh truy nã", "bắt tạm giam"],
    "involved": ["liên quan", "dính"],
    "crime": ["rửa tiền", "ma túy", "vụ án", "đường dây"],
    "do not": ["không được", "đừng", "tuyệt đối không"],
    "tell": ["nói", "kể", "tiết lộ", "báo"],
    "others": ["ai", "người nhà", "gia đình", "người khác"],
    "remote tool": ["teamviewer", "anydesk", "ultraviewer", "điều khiển từ xa"],
    "install": ["cài", "cài đặt", "tải"],
    "app": ["ứng dụng", "phần mềm", "app"],
    "open": ["bấm", "mở", "truy cập", "nhấn"],
    "link": ["đường link", "link"],
    "share": ["chia sẻ"],
    "screen": ["màn hình"],
    "prize": ["trúng thưởng", "trúng giải", "nhận quà tri ân"],
    "profit": ["cam kết lợi nhuận", "lãi suất cao", "không rủi ro"],
    "buy": ["mua"],
    "top-up card": ["thẻ cào", "thẻ nạp", "thẻ điện thoại"],
    "hand over": ["nối máy", "chuyển máy"],
    "colleague": ["đồng nghiệp", "cán bộ", "cấp trên", "đồng chí"],
}

REQUEST = ["denied", "by speaker", "done", "own"]
#: (rule, code, severity, kinds in order with the most words before each, place of the anchor, guards).
RULES = [
    ("read-code", "OTP_REQUEST", "HIGH", [("give", 0), ("code", 4)], 0, REQUEST),
    ("code-into-page", "OTP_REQUEST", "HIGH", [("type in", 0), ("code", 3), ("page", 4)], 0, REQUEST),
    ("code-then-read", "OTP_REQUEST", "HIGH", [("code", 0), ("read out", 5), ("to me", 2)], 1, REQUEST),
    ("fresh-code-then-read", "OTP_REQUEST", "HIGH", [("fresh code", 0), ("read out", 9), ("to me", 2)], 1, REQUEST),
    ("ask-for-code", "OTP_REQUEST", "HIGH", [("to me", 0), ("code", 2)], 0, REQUEST),
    ("move-to-theirs", "MONEY_TRANSFER", "HIGH", [("move", 0), ("sum", 4), ("into", 4), ("of theirs", 1)], 0, ["denied", "by speaker", "done"]),
    ("move-to-safe", "MONEY_TRANSFER", "HIGH", [("move", 0), ("sum", 4), ("holding account", 2)], 0, ["denied", "by speaker", "done"]),
    ("pay-or-else", "MONEY_TRANSFER", "MEDIUM", [("unless", 0), ("pay", 1)], 0, ["own", "asked"]),
    ("must-pay", "MONEY_TRANSFER", "MEDIUM", [("must", 0), ("pay", 3)], 1, ["denied", "by speaker", "done", "offer", "asked"]),
    ("pay-now", "MONEY_TRANSFER", "MEDIUM", [("pay", 0), ("now", 2)], 0, ["denied", "by speaker", "done", "offer", "asked"]),
    ("pay-to-holding", "MONEY_TRANSFER", "HIGH", [("pay", 0), ("holding account", 4)], 0, ["denied", "by speaker", "done"]),
    ("from-bank", "BANK_IMPERSONATION", "LOW", [("speaker", 0), ("calls from", 3), ("bank", 2)], 1, ["denied", "asked back"]),
    ("staff-of-bank", "BANK_IMPERSONATION", "LOW", [("speaker", 0), ("staff", 1), ("bank", 6)], 1, ["denied", "asked back"]),
    ("desk-of-bank", "BANK_IMPERSONATION", "LOW", [("bank desk", 0), ("bank", 1)], 0, ["denied", "asked"]),
    ("must-within", "URGENCY", "LOW", [("must", 0), ("within", 4), ("time", 3)], 0, ["denied", "by speaker", "asked"]),
    ("within-or-else", "URGENCY", "LOW", [("within", 0), ("time", 4), ("unless", 2)], 0, ["denied", "asked"]),
    ("last-places", "URGENCY", "LOW", [("or none", 0)], 0, ["denied", "asked"]),
    ("hurry-pay", "URGENCY", "LOW", [("pay", 0), ("now", 2)], 0, ["denied", "by speaker", "done"]),
    ("hurry-do", "URGENCY", "LOW", [("do", 0), ("now", 3)], 0, ["denied", "by speaker", "done"]),
    ("account-locked", "ACCOUNT_LOCK_THREAT", "MEDIUM", [("account", 0), ("be", 5), ("locked", 2)], 0, ["own", "asked", "denied inside"]),
    ("read-password", "SENSITIVE_INFORMATION", "HIGH", [("give", 0), ("password", 4)], 0, REQUEST),
    ("read-papers", "SENSITIVE_INFORMATION", "MEDIUM", [("give", 0), ("papers", 4)], 0, REQUEST),
    ("give-account-number", "SENSITIVE_INFORMATION", "LOW", [("give", 0), ("account number", 4)], 0, [*REQUEST, "to pay"]),
    ("photo-of-card", "SENSITIVE_INFORMATION", "HIGH", [("photograph", 0), ("bank card", 5), ("send", 3)], 0, REQUEST),
    ("digits-on-card", "SENSITIVE_INFORMATION", "HIGH", [("read out", 0), ("digits on", 2), ("bank card", 1)], 0, REQUEST),
    ("video-of-face", "SENSITIVE_INFORMATION", "MEDIUM", [("film", 0), ("face", 1), ("send", 6), ("to me", 0)], 0, REQUEST),
    ("tell-holdings", "SENSITIVE_INFORMATION", "MEDIUM", [("let me know", 0), ("holdings", 9)], 0, REQUEST),
    ("from-police", "AUTHORITY_IMPERSONATION", "LOW", [("speaker", 0), ("officer of", 3), ("police", 3)], 1, ["denied", "asked back"]),
    ("prosecuted", "LEGAL_THREAT", "MEDIUM", [("prosecution", 0)], 0, ["denied", "asked"]),
    ("involved-in-crime", "LEGAL_THREAT", "MEDIUM", [("involved", 0), ("crime", 4)], 0, ["denied"]),
    ("tell-nobody", "SECRECY_DEMAND", "MEDIUM", [("do not", 0), ("tell", 2), ("others", 3)], 0, ["about secrets"]),
    ("between-us", "SECRECY_DEMAND", "MEDIUM", [("between us", 0)], 0, ["denied", "asked"]),
    ("not-speak-out", "SECRECY_DEMAND", "MEDIUM", [("do not", 0), ("speak out", 0)], 0, ["about secrets"]),
    ("people-to-house", "HARM_THREAT", "MEDIUM", [("send people", 0), ("house", 1)], 0, ["denied just before", "asked"]),
    ("pictures-to-contacts", "HARM_THREAT", "HIGH", [("pictures", 0), ("contacts", 4)], 0, ["denied just before", "asked"]),
    ("leak-pictures", "HARM_THREAT", "HIGH", [("leak", 0)], 0, ["denied", "asked"]),
    ("sign-in-by-link", "REMOTE_ACCESS_REQUEST", "HIGH", [("link", 0), ("bank sign-in", 6)], 0, ["denied", "by speaker", "done"]),
    ("remote-tool", "REMOTE_ACCESS_REQUEST", "HIGH", [("remote tool", 0)], 0, ["denied"]),
    ("install-app", "REMOTE_ACCESS_REQUEST", "MEDIUM", [("install", 0), ("app", 3)], 0, ["denied", "by speaker", "done"]),
    ("open-link", "REMOTE_ACCESS_REQUEST", "MEDIUM", [("open", 0), ("link", 3)], 0, ["denied", "by speaker", "done"]),
    ("share-screen", "REMOTE_ACCESS_REQUEST", "MEDIUM", [("share", 0), ("screen", 2)], 0, ["denied"]),
    ("prize", "FINANCIAL_BAIT", "MEDIUM", [("prize", 0)], 0, ["denied", "asked"]),
    ("twice-back", "FINANCIAL_BAIT", "MEDIUM", [("give back", 0), ("twice", 2)], 0, ["denied", "asked"]),
    ("top-up-as-told", "FINANCIAL_BAIT", "MEDIUM", [("top up", 0), ("as told", 1)], 0, ["denied", "by speaker", "done", "asked"]),
    ("sure-profit", "FINANCIAL_BAIT", "MEDIUM", [("profit", 0)], 0, ["denied"]),
    ("buy-cards", "UNUSUAL_PAYMENT", "MEDIUM", [("buy", 0), ("top-up card", 3)], 0, ["denied", "by speaker"]),
    ("handed-over", "CALL_HANDOFF", "LOW", [("hand over", 0), ("colleague", 3)], 0, ["denied"]),
]
#: Sharing the screen with any of these makes remote access HIGH.
SCREEN_WITH = ["install-app", "open-link"]

_DENIALS = ["không", "đừng", "chớ", "chưa"]
_CALMING = ["lo", "sợ", "ngại", "tắt", "cúp", "ngắt", "gác"]
_SELF = ["tôi", "mình", "em", "cháu", "con", "tớ"]
_MODAL = ["sẽ", "đang", "cũng", "phải", "muốn", "cần"]


def _in(words: Column, some: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in some]))


def _before(n: int) -> Column:
    return F.slice("words", F.greatest(F.col("anchor") - n + 1, F.lit(1)), F.least(F.col("anchor"), F.lit(n)))


def _after(n: int) -> Column:
    return F.slice("words", F.col("after") + 1, n)


def _matched() -> Column:
    return F.slice("words", F.col("first") + 1, F.col("after") - F.col("first"))


def _phrase(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _denied() -> Column:
    """A denial shortly before, but not a condition, nor a word of comfort (do not worry, do not hang up)."""
    b = _before(6)
    meant = F.filter(b, lambda w, i: w.isin(_DENIALS) & ~F.coalesce(F.get(b, i + 1).isin(_CALMING), F.lit(False)))
    return (F.size(meant) > 0) & ~F.array_contains(b, "nếu")


#: Whether a hit does not count; of a hit with words (its clause), first, anchor, after and question.
GUARDS: dict[str, Callable[[], Column]] = {
    "denied": _denied,
    "denied just before": lambda: _in(_before(2), _DENIALS),
    "denied inside": lambda: _in(_matched(), ["không", "chưa"]),
    "by speaker": lambda: F.coalesce(F.element_at(F.filter(F.concat(F.array(F.lit("")), _before(4)), lambda w: ~w.isin(_MODAL)), -1).isin(_SELF), F.lit(False)),
    "done": lambda: _in(_before(1), ["đã", "vừa", "mới"]),
    "own": lambda: _phrase(F.concat(_matched(), _after(12))).rlike(" của (chính )?(tôi|mình) "),
    "offer": lambda: _phrase(_before(2)).rlike("^ để (tôi|mình|em|cháu|con|anh|chị) $"),
    "asked": lambda: F.col("question"),
    "asked back": lambda: _phrase(_after(3)).rlike("^ ([^ ]+ )?(à|hả|chứ|phải không|đúng không) "),
    "to pay": lambda: _phrase(_after(10)).rlike(" để ([^ ]+ ){0,2}(chuyển|trả|gửi|thanh toán) "),
    "about secrets": lambda: _phrase(F.col("words")).rlike(" (otp|mã|mật khẩu|pin|cvv) "),
}


def clauses(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, clause, words, question): the clauses of ``texts(keys, text)`` in their normal form."""
    marked = texts.select(*keys, F.posexplode_outer(F.regexp_extract_all(normalised(F.col("text")), F.lit(r"[^|]+(\|\||\||$)"), F.lit(0))).alias("clause", "c"))
    cut = marked.where("c is not null").select(*keys, "clause", F.trim(F.rtrim("c", F.lit("|"))).alias("said"), F.col("c").endswith("||").alias("question"))
    return cut.where("said <> ''").select(*keys, "clause", F.split("said", " ").alias("words"), "question")


def with_places(parts: DataFrame) -> DataFrame:
    """``parts`` with places, an array of (kind, first, after): where phrases of the lexicon stand.  Clauses without a word that begins a phrase go."""
    kinds: dict[str, list[str]] = {}
    for kind, some in LEXICON.items():
        for p in some:
            kinds.setdefault(p, []).append(kind)
    leads = sorted({p.split()[0] for p in kinds})
    of = F.create_map(*[c for p, some in kinds.items() for c in (F.lit(p), F.array(*[F.lit(k) for k in some]))])
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(leads))
    groups = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("words") - i)), lambda n: F.struct(
        i.alias("first"), (i + n).alias("after"), F.array_join(F.slice("words", i + 1, n), " ").alias("phrase")))))
    known = F.filter(groups, lambda g: g["phrase"].isin(list(kinds)))
    found = F.flatten(F.transform(known, lambda g: F.transform(F.element_at(of, g["phrase"]), lambda k: F.struct(k.alias("kind"), g["first"].alias("first"), g["after"].alias("after")))))
    return parts.where(F.exists("words", lambda w: w.isin(leads))).withColumn("places", found)


def rule_hits(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule, code, severity, evidence): hits of the rules in ``texts(keys, text)`` that no guard takes back.

    Of the hits of a rule that begin at one word the shortest counts.  A null text has none.
    A clause is a row with its places, so a text is put into its normal form once and
    only hits are shuffled.
    """
    spark = texts.sparkSession
    table = spark.createDataFrame([(r[3][0][0], r[0], r[1], r[2], [k for k, _ in r[3]], [n for _, n in r[3]], r[4], r[5]) for r in RULES],
                                  "kind string, rule string, code string, severity string, kinds array<string>, gaps array<int>, mark int, guards array<string>")
    about = [*keys, "clause", "words", "question", "places", "rule", "code", "severity", "kinds", "gaps", "mark", "guards"]
    placed = with_places(clauses(texts, *keys)).select(*keys, "clause", "words", "question", "places", F.explode_outer("places").alias("p")).where("p is not null")
    so_far = placed.select("*", F.col("p.kind").alias("kind")).join(F.broadcast(table), "kind").select(
        *about, F.col("p.first").alias("first"), F.col("p.after").alias("after"), F.when(F.col("mark") == 0, F.col("p.first")).alias("anchor"))
    for k in range(1, max(len(r[3]) for r in RULES)):
        kind, gap, marked = F.get("kinds", F.lit(k)), F.get("gaps", F.lit(k)), F.col("mark") == k
        then = F.filter("places", lambda p: (p["kind"] == kind) & (p["first"] >= F.col("after")) & (p["first"] - F.col("after") <= gap))  # noqa: B023
        step = lambda p: F.struct(p["after"].alias("after"), F.when(marked, p["first"]).otherwise(F.col("anchor")).alias("anchor"))  # noqa: B023, E731
        on = F.when(F.size("kinds") > k, F.transform(then, step)).otherwise(F.array(F.struct("after", "anchor")))
        so_far = so_far.select(*about, "first", F.explode_outer(on).alias("p")).where("p is not null").select(*about, "first", "p.after", "p.anchor")
    refused = F.lit(False)
    for name, guard in GUARDS.items():
        refused = refused | (F.array_contains("guards", name) & guard())
    judged = so_far.select(*keys, "clause", "rule", "code", "severity", "first", F.struct("after", "anchor", refused.alias("refused"), F.array_join(_matched(), " ").alias("evidence")).alias("hit"))
    one = judged.groupBy(*keys, "clause", "rule", "code", "severity", "first").agg(F.min("hit").alias("hit"))
    return one.where("not hit.refused").select(*keys, "rule", "code", "severity", "hit.evidence", "clause", "first")


def _rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def merged(hits: DataFrame, *keys: str) -> DataFrame:
    """(keys, code, severity, evidence, rules): one row for each indicator, its evidence in the order of the text.

    Screen sharing together with an installation or a link makes remote access HIGH,
    by the further rule ``screen-and-access``.
    """
    firsts = hits.groupBy(*keys, "code", "evidence").agg(F.min(F.struct("clause", "first")).alias("place"))
    evidence = firsts.groupBy(*keys, "code").agg(F.array_sort(F.collect_list(F.struct("place", "evidence"))).alias("e")).select(
        *keys, "code", F.transform(F.slice("e", 1, MOST_EVIDENCE), lambda x: x["evidence"]).alias("evidence"))
    rules = hits.groupBy(*keys, "code").agg(F.max(_rank(F.col("severity"))).alias("most"), F.array_sort(F.collect_set("rule")).alias("rules"))
    both = (F.col("code") == "REMOTE_ACCESS_REQUEST") & F.array_contains("rules", "share-screen") & _in(F.col("rules"), SCREEN_WITH)
    level = F.when(both, "HIGH").otherwise(F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("most").cast("int")))
    return rules.join(evidence, [*keys, "code"]).select(
        *keys, "code", level.alias("severity"), "evidence", F.when(both, F.concat("rules", F.array(F.lit("screen-and-access")))).otherwise(F.col("rules")).alias("rules"))


def indicators(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, code, severity, evidence, rules) of texts without speakers, ``texts(key, text)``."""
    return merged(Staging(texts.sparkSession).save(rule_hits(texts, key), "hits"), key)


def conversation(turns: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(indicators, speakers) of ``turns(key, turn, speaker, text)``: each speaker is judged by their own words.

    One who only asks for an account number while another asks for money is about to
    be paid or to pay, so that hit goes.  Two speakers who put pressure on the person
    called are coordinated.  speakers is (key, speaker, turns, codes).  A null speaker
    counts as one without a name, the empty string.
    """
    turns = turns.withColumn("speaker", F.coalesce("speaker", F.lit("")))
    hits = Staging(turns.sparkSession).save(rule_hits(turns, key, "turn", "speaker"), "hits")
    hits = hits.withColumn("clause", F.struct("turn", "clause"))
    asks = F.collect_set(F.when(F.col("code") == "SENSITIVE_INFORMATION", F.col("rule"))).alias("asks")
    each = hits.groupBy(key, "speaker").agg(asks, F.bool_or(F.col("code") == "MONEY_TRANSFER").alias("wants"))
    wanting = each.groupBy(key).agg(F.count_if("wants").alias("wanting"))
    only = (each.join(wanting, key).where(F.col("asks") == F.array(F.lit("give-account-number")))
            .where(F.col("wanting") - F.col("wants").cast("int") > 0).select(key, "speaker", F.lit("give-account-number").alias("rule")))
    left = hits.join(only, [key, "speaker", "rule"], "left_anti")
    own = merged(left, key, "speaker")
    pressing = own.where(F.col("code").isin(PRESSING) | ((F.col("code") == "SENSITIVE_INFORMATION") & (F.col("severity") != "LOW")))
    many = pressing.groupBy(key).agg(F.array_sort(F.collect_set("speaker")).alias("s")).where(F.size("s") >= 2)
    together = many.select(key, F.lit("COORDINATED_CALLERS").alias("code"), F.lit("MEDIUM").alias("severity"),
                           F.array(F.concat(F.lit("speakers: "), F.array_join("s", ", "))).alias("evidence"), F.array(F.lit("coordinated")).alias("rules"))
    codes = own.groupBy(key, "speaker").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    said = turns.groupBy(key, "speaker").agg(F.count(F.lit(1)).cast("int").alias("turns"))
    speakers = said.join(codes, [key, "speaker"], "left").select(key, "speaker", "turns", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))
    return merged(left, key).unionByName(together), speakers
