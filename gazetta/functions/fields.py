"""Fields of notices by lists of forms, of which the first that is found counts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of the fields of a detail page, in the order in which they are tried (fixed values).
FORMS = {
    "budget": (
        r"预算金额[：:]\s*([\d,\.]+)\s*(?:万元|元)",
        r"采购预算[：:]\s*([\d,\.]+)\s*(?:万元|元)",
        r"项目预算[：:]\s*([\d,\.]+)\s*(?:万元|元)",
        r"最高限价[：:]\s*([\d,\.]+)\s*(?:万元|元)",
    ),
    "deadline": (
        r"投标截止时间[：:]*\s*([^\n]+)",
        r"截止时间[：:]*\s*([^\n]+)",
        r"投标文件递交截止时间[：:]*\s*([^\n]+)",
        r"截止日期[：:]*\s*([^\n]+)",
        r"(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?\s*\d{1,2}[:时]\d{1,2}分?)",
    ),
    "bid_amount": (
        r"中标金额[：:]\s*([\d,\.]+)\s*(?:万元|元)",
        r"成交金额[：:]\s*([\d,\.]+)\s*(?:万元|元)",
        r"合同金额[：:]\s*([\d,\.]+)\s*(?:万元|元)",
    ),
    "supplier": (r"中标供应商[：:]\s*([^\n]+)", r"中标人[：:]\s*([^\n]+)", r"成交供应商[：:]\s*([^\n]+)"),
    "overview": (r"项目概况[：:]\s*([^\n]+)", r"采购内容[：:]\s*([^\n]+)", r"项目简介[：:]\s*([^\n]+)"),
    "requirements": (r"资格要求[：:]\s*([^\n]+)",),
    "opening": (r"开标时间[：:]\s*([^\n]+)",),
    "contact": (r"联系人[：:]\s*([^\s\n,，/]+)", r"联\s*系\s*人[：:]\s*([^\s\n,，/]+)", r"项目联系人[：:]\s*([^\s\n,，/]+)"),
    "phone": (r"电话[：:]\s*([\d\-]+)", r"联系电话[：:]\s*([\d\-]+)", r"联系方式[：:]\s*([\d\-]+)", r"Tel[：:]\s*([\d\-]+)", r"手机[：:]\s*([\d\-]+)"),
    "email": (r"([\w\.-]+@[\w\.-]+\.\w+)",),
    "address": (r"地址[：:]\s*([^\n]+?)(?=\s*(?:电话|联系|邮编|$))", r"联系地址[：:]\s*([^\n]+)"),
}
#: Forms of the fields of an abstract; of a contact all that are found are kept (fixed values).
ABSTRACT_BUDGET = (
    r"预算[：:：]?\s*([\d,，.]+)\s*(?:万元|元|万)",
    r"最高限价[：:：]?\s*([\d,，.]+)\s*(?:万元|元|万)",
    r"合同估算[：:：]?\s*([\d,，.]+)\s*(?:万元|元|万)",
    r"采购预算[：:：]?\s*([\d,，.]+)\s*(?:万元|元|万)",
)
ABSTRACT_DAY = r"[：:：]?\s*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?(?:\s*\d{1,2}[时:：]\d{1,2})?)"
ABSTRACT_DEADLINE = (r"截止[时分]?" + ABSTRACT_DAY, r"报名截止[时分]?" + ABSTRACT_DAY, r"开标[时分]?" + ABSTRACT_DAY, r"响应[时分]?" + ABSTRACT_DAY)
ABSTRACT_CONTACT = (
    r"联系人[：:：]?\s*([^\s，。,，]+)",
    r"电话[：:：]?\s*([\d\-–]{7,})",
    r"手机[：:：]?\s*([1][3-9]\d{9})",
    r"邮箱[：:：]?\s*([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)",
)
#: Districts in the order in which they are looked for, and the region of a text without any (fixed values).
DISTRICTS = (
    "渝中区", "大渡口区", "江北区", "沙坪坝区", "九龙坡区", "南岸区",
    "北碚区", "渝北区", "巴南区", "万州区", "涪陵区", "永川区",
    "合川区", "江津区", "綦江区", "长寿区", "大足区", "璧山区",
    "铜梁区", "潼南区", "荣昌区", "黔江区", "两江新区",
)
REGION = "重庆市"


def first_form(text: Column, forms: tuple[str, ...], group: int = 1) -> Column:
    """What the first form that is found anywhere says, without outer blanks; null without any."""
    return F.coalesce(*[F.nullif(F.regexp_replace(F.regexp_extract(text, "(?U)" + form, group), r"(?U)^\s+|\s+$", ""), F.lit("")) for form in forms])


def page_fields(text: Column) -> Column:
    """Struct of the FORMS of a page, ``due`` and ``opens`` as times of the deadline and the opening, and the region. Null text is blank."""
    text = F.coalesce(text, F.lit(""))
    found = {name: first_form(text, forms) for name, forms in FORMS.items()}
    times = [moment(found["deadline"]).alias("due"), moment(found["opening"]).alias("opens")]
    return F.struct(*[c.alias(name) for name, c in found.items()], *times, region(text).alias("region"))


def moment(text: Column) -> Column:
    """A day with hours and minutes, in figures or with their signs, as a timestamp; null for texts of other forms."""
    plain = text
    for sign, mark in (("年", "-"), ("月", "-"), ("日", " "), ("时", ":"), ("分", "")):
        plain = F.replace(plain, F.lit(sign), F.lit(mark))
    plain = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    read_as = lambda t, form: F.try_to_timestamp(t, F.lit(form))
    by_seconds = lambda t, day: F.when(t.rlike(":.*:"), read_as(t, f"{day} H:m:s")).otherwise(read_as(t, f"{day} H:m"))
    # the signs of a text leave one form; the lambda computes the text once
    return F.transform(F.array(plain), lambda t: F.when(F.contains(t, F.lit("/")), by_seconds(t, "y/M/d")).otherwise(by_seconds(t, "y-M-d")))[0]


def region(text: Column) -> Column:
    """The first of the districts that the text names, else the region of all."""
    out = F.lit(REGION)
    for name in reversed(DISTRICTS):
        out = F.when(F.contains(text, F.lit(name)), name).otherwise(out)
    return out


def line_at(text: Column, words: tuple[str, ...], most: int = 200, context: int = 100, least: int = 20) -> Column:
    """The line from the first of the words on, of at most ``context`` characters; a word whose line has up to ``least`` characters doesn't
    count. Blank without any."""
    text, out = F.coalesce(text, F.lit("")), F.lit("")
    for word in reversed(words):
        at = F.instr(text, word)
        line = F.trim(F.element_at(F.split(F.substring(text, at, F.lit(context)), "\n"), 1))
        out = F.when((at > 0) & (F.length(line) > least), F.left(line, F.lit(most))).otherwise(out)
    return out


def abstract(text: Column) -> Column:
    """Struct of budget, deadline and contact as an abstract names them, blank where nothing is found."""
    text = F.coalesce(text, F.lit(""))
    contact = F.concat_ws("；", *[F.nullif(F.regexp_extract(text, "(?U)" + form, 0), F.lit("")) for form in ABSTRACT_CONTACT])
    told = lambda forms, group: F.coalesce(first_form(text, forms, group), F.lit(""))
    return F.struct(told(ABSTRACT_BUDGET, 0).alias("budget"), told(ABSTRACT_DEADLINE, 1).alias("deadline"), contact.alias("contact"))
