"""The acceptance cases of the rules, as written and as a recogniser writes them."""

import re

from pyspark.sql import functions as F

from ringwarden.functions.rules import CODES, GUARDS, LEXICON, LONGEST, RULES, conversation, indicators, rule_hits
from ringwarden.functions.transcripts import speaker_turns

#: Sentences and the codes that they must give.
CASES = [
    ("Tôi mua hàng của bạn.", set()),
    ("Cho tôi số tài khoản để tôi chuyển tiền.", set()),
    ("Tôi gọi từ ngân hàng. Tài khoản của anh đang có vấn đề. Cho tôi số tài khoản.", {"BANK_IMPERSONATION", "SENSITIVE_INFORMATION"}),
    ("Tôi gọi từ ngân hàng. Tài khoản của anh đang có vấn đề. Anh đọc mã OTP tôi vừa gửi.", {"BANK_IMPERSONATION", "OTP_REQUEST"}),
    ("Chuyển tiền ngay nếu không tài khoản sẽ bị khóa.", {"URGENCY", "ACCOUNT_LOCK_THREAT", "MONEY_TRANSFER"}),
    ("Tôi đăng nhập ngân hàng và nhập OTP của chính tôi.", set()),
    ("Không được đọc mã OTP cho ai.", set()),
    ("Anh hãy cài ứng dụng này rồi chia sẻ màn hình cho em.", {"REMOTE_ACCESS_REQUEST"}),
]
#: Warnings and words of comfort.
MORE = [
    ("Tài khoản của anh sẽ không bị khóa.", set()),
    ("Chị không được nói mã OTP cho ai.", set()),
    ("Đừng tắt máy, chị đọc mã OTP cho em.", {"OTP_REQUEST"}),
    ("Anh đừng lo, anh đọc mã OTP cho em.", {"OTP_REQUEST"}),
    ("Chị không được nói với ai.", {"SECRECY_DEMAND"}),
    (None, set()),
]

#: Published requests and threats with a code that they must give.
ASKED = [
    ("mã otp vừa về máy anh đọc cho em nhé", "OTP_REQUEST"), ("anh đọc mã ô tê pê cho em", "OTP_REQUEST"), ("đọc cho em mã o t p", "OTP_REQUEST"),
    ("Chị cho em xin mã OTP vừa gửi về điện thoại.", "OTP_REQUEST"), ("Anh báo lại mã xác nhận cho bên em ạ.", "OTP_REQUEST"),
    ("Có một mã sáu số gửi về máy chị, chị đọc cho em nhé.", "OTP_REQUEST"), ("mã vừa gửi về máy anh đọc lại giúp em", "OTP_REQUEST"),
    ("Bên em vừa gửi về điện thoại bác một mã, bác đọc cho cháu.", "OTP_REQUEST"),
    ("Nếu không chuyển tiền thì hồ sơ sẽ được gửi sang công an.", "MONEY_TRANSFER"), ("Chị chuyển mười hai triệu vào tài khoản của cán bộ thụ lý.", "MONEY_TRANSFER"),
    ("Cô chuyển tám triệu tiền sắm lễ vào tài khoản của thầy.", "MONEY_TRANSFER"), ("Bác chuyển toàn bộ tiền sang tài khoản ký quỹ tạm thời.", "MONEY_TRANSFER"),
    ("Anh chuyển toàn bộ tiền vào tài khoản an toàn của chúng tôi.", "MONEY_TRANSFER"),
    ("Em là nhân viên chăm sóc khách hàng của ngân hàng Vietcombank.", "BANK_IMPERSONATION"), ("Đây là tổng đài ngân hàng Techcombank.", "BANK_IMPERSONATION"),
    ("Chị phải xác nhận trong vòng 5 phút.", "URGENCY"), ("Trong vòng hai mươi bốn giờ nếu không xử lý tài khoản sẽ bị khóa.", "URGENCY"), ("Anh chuyển ngay kẻo hết suất.", "URGENCY"),
    ("Anh chụp ảnh thẻ ATM gửi qua Zalo cho em.", "SENSITIVE_INFORMATION"), ("Chị đừng tắt máy, chị đọc từng số trên thẻ ATM cho em.", "SENSITIVE_INFORMATION"),
    ("Anh quay video khuôn mặt nghiêng trái nghiêng phải gửi cho em để mở khóa tài khoản.", "SENSITIVE_INFORMATION"),
    ("Chị cho em biết tài khoản chị có bao nhiêu tiền để em khoanh lại.", "SENSITIVE_INFORMATION"),
    ("Bác bấm vào đường link cháu nhắn rồi đăng nhập ngân hàng để nhận tiền hoàn.", "REMOTE_ACCESS_REQUEST"),
    ("Việc này kín, chị yên tâm.", "SECRECY_DEMAND"), ("Việc này tôi giúp riêng, đừng nói ra.", "SECRECY_DEMAND"),
    ("Không trả thì chúng tôi cho người đến tận nhà.", "HARM_THREAT"), ("Em gửi hình chị cho hết danh bạ.", "HARM_THREAT"),
    ("Chiều tôi chuyển lại gấp đôi.", "FINANCIAL_BAIT"), ("Chị vào nhóm rồi nạp tiền theo hướng dẫn để bé lên hạng.", "FINANCIAL_BAIT"),
]
#: Published sentences that ask for nothing.
HARMLESS = [
    "Tôi vừa nhận được mã OTP.", "Tôi sẽ đọc mã OTP cho anh.", "Ngân hàng đã gửi mã OTP cho tôi.", "Anh đã đọc mã OTP cho ai chưa?", "Mã OTP của tôi hết hạn rồi.",
    "Tuyệt đối không cung cấp mã OTP cho bất kỳ ai.", "Đừng đọc mã OTP cho ai, kể cả nhân viên ngân hàng.", "Anh đọc báo đi. Mã OTP là gì vậy?",
    "Anh đọc mã đơn hàng cho em để em tìm kiện hàng ạ.", "Ngân hàng dặn không đọc mã gửi về máy cho bất kỳ ai.",
    "Hôm qua có người bảo tôi đọc mã vừa gửi về máy cho họ, tôi cúp máy luôn.", "Tôi chụp ảnh thẻ ngân hàng của tôi để lưu lại cho khỏi quên.",
    "Đừng chụp thẻ ngân hàng gửi cho ai nhé mẹ.", "Em đọc số trên thẻ thư viện giúp cô để cô ghi sổ mượn sách.", "Tôi quay video khuôn mặt em bé gửi cho bà xem.",
    "Em ơi cho chị biết tài khoản của tôi còn bao nhiêu tiền với.", "Ngân hàng không bao giờ yêu cầu khách kê khai số dư qua điện thoại.",
    "Đừng bấm vào đường link lạ rồi đăng nhập ngân hàng nhé bố.", "Tôi đăng nhập ngân hàng và nhập OTP của chính tôi.", "Tôi là khách hàng của ngân hàng.",
    "Anh là nhân viên ngân hàng à?", "Tôi không phải là nhân viên ngân hàng.", "Tôi sẽ chuyển tiền cho anh vào ngày mai.", "Tôi không chuyển tiền đâu.",
    "Thông tin của anh được giữ kín theo quy định.", "Shipper giao hàng đến tận nhà cho chị nhé.",
]


def test_requests_and_harmless_sentences(spark):
    out = found(spark, [t for t, _ in ASKED] + HARMLESS)
    missed = [t for i, (t, code) in enumerate(ASKED) if code not in out[i]]
    alarms = [(t, set(out[len(ASKED) + i])) for i, t in enumerate(HARMLESS) if out[len(ASKED) + i]]
    assert (missed, alarms) == ([], [])


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {i: {} for i in range(len(texts))}
    for r in indicators(df).collect():
        out[r.id][r.code] = r
    return out


def test_cases(spark):
    written = [t for t, _ in CASES + MORE]
    spoken = [re.sub(r"[^\w\s]", "", t.lower()) for t, _ in CASES]
    out = found(spark, written + spoken)
    assert [set(out[i]) for i in range(len(written))] == [w for _, w in CASES + MORE]
    assert [set(out[len(written) + i]) for i in range(len(CASES))] == [w for _, w in CASES]
    high = [{c for c, r in out[i].items() if r.severity == "HIGH"} for i in (2, 3, 7)]
    assert high == [set(), {"OTP_REQUEST"}, {"REMOTE_ACCESS_REQUEST"}] and "screen-and-access" in out[7]["REMOTE_ACCESS_REQUEST"].rules
    assert out[3]["OTP_REQUEST"].evidence == ["đọc mã otp"]


def test_catalogue():
    assert len({r[0] for r in RULES}) == len(RULES) and {r[1] for r in RULES} <= set(CODES)
    assert all(kind in LEXICON for r in RULES for kind, _ in r[3]) and all(g in GUARDS for r in RULES for g in r[5])
    assert max(len(p.split()) for some in LEXICON.values() for p in some) <= LONGEST


def test_conversations(spark):
    rows = [(1, "A: Tôi gọi từ công an. B: Vâng. C: Anh đọc mã OTP cho tôi. A: Anh nghe chưa. C: Nhanh lên."),
            (2, "A: Chị chuyển khoản ngay cho shop. B: Cho em số tài khoản. A: Vâng ạ. B: Cảm ơn chị.")]
    df = spark.createDataFrame(rows, "id int, text string")
    turns = df.select("id", F.posexplode(speaker_turns(F.col("text"))).alias("turn", "t")).select("id", "turn", "t.*")
    whole, speakers = conversation(turns)
    codes = {(r.id, r.code) for r in whole.collect()}
    assert (1, "COORDINATED_CALLERS") in codes and (2, "SENSITIVE_INFORMATION") not in codes and (2, "MONEY_TRANSFER") in codes
    assert (2, "SENSITIVE_INFORMATION") in {(r.id, r.code) for r in indicators(df).collect()}
    told = {(r.id, r.speaker): (r.turns, r.codes) for r in speakers.collect()}
    assert told[1, "B"] == (1, []) and told[1, "C"] == (2, ["OTP_REQUEST"]) and told[1, "A"][0] == 2


def test_a_speaker_without_a_name(spark):
    rows = [(2, 0, "A", "Chị chuyển khoản ngay cho shop."), (2, 1, None, "Cho em số tài khoản."), (3, 0, None, "Anh đọc mã OTP cho tôi.")]
    whole, speakers = conversation(spark.createDataFrame(rows, "id int, turn int, speaker string, text string"))
    codes = {(r.id, r.code) for r in whole.collect()}
    assert (2, "SENSITIVE_INFORMATION") not in codes and (2, "MONEY_TRANSFER") in codes and (3, "OTP_REQUEST") in codes
    assert {(r.id, r.speaker): r.turns for r in speakers.collect()} == {(2, "A"): 1, (2, ""): 1, (3, ""): 1}


def test_a_text_is_read_once(spark):
    df = spark.createDataFrame([(1, CASES[3][0])], "id int, text string")
    plan = rule_hits(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("Exchange hashpartitioning") == 1
