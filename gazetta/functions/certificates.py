"""Fields of certificates and licences from their text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import labelled_field

#: Kinds of certificates and signs in their text; most signs win, earlier kinds first, the last kind without any (fixed values).
KINDS = {
    "身份证": (r"公民身份号码", r"居民身份证", r"身份证号", r"\d{17}[\dXx]", r"性别[男女]", r"出生[年月日在]", r"民族[汉蒙藏回]"),
    "建造师": (r"注册建造师", r"一级建造师", r"二级建造师", r"建造师证书", r"建筑.+号", r"专业:"),
    "工程师": (r"工程师", r"高级工程师", r"中级工程师", r"职称证书", r"专业技术职务", r"任职资格"),
    "安全员": (r"安全员", r"安全生产考核", r"安全考核合格证", r"建筑施工企业", r"三类人员"),
    "营业执照": (r"营业执照", r"统一社会信用代码", r"法定代表人", r"注册资本", r"注册地址", r"经营范围", r"企业名称", r"成立日期"),
    "资质证书": (r"资质证书", r"建筑业企业资质", r"安全生产许可证", r"等级证书", r"许可证书"),
}
#: Titles and levels in order of precedence, labels of the other fields (fixed values).
TITLES = ("高级工程师", "中级工程师", "初级工程师", "一级建造师", "二级建造师", "注册建造师", "高级经济师", "中级经济师", "工程师", "经济师", "会计师")
LEVELS = ("特级", "一级", "二级", "三级", "甲级", "乙级", "丙级", "丁级")
ISSUERS, ADDRESSES = ("发证机关", "颁发机关", "发证单位", "签发机关"), ("注册地址", "地址", "营业场所")
PERSONS, PLACES = ("法定代表人", "法人代表", "负责人"), ("注册地[区点]", "注册单位", "工作单位", "聘用企业")
NUMBERS = (r"注册编号[：:\s]*([A-Z0-9\-]{6,20})", r"注册建造师[：:\s]*([A-Z0-9\-]{6,20})", r"证书编号[：:\s]*([A-Z0-9\-]{5,})", r"编号[：:\s]*([A-Z0-9]{5,})")
HOLDERS = (r"姓\s*名[：:\s]*([^\n,，、]{2,8})", r"持有人[：:\s]*([^\n,，、]{2,8})", r"本人[：:\s]*([^\n,，、]{2,8})")
_DAY = r"(\d{4})[年\-/](\d{1,2})[月\-/](\d{1,2})日?"


def _first(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def _named(text: Column, words: tuple[str, ...]) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(0))


def _day(text: Column, before: str) -> Column:
    part = lambda k: F.regexp_extract(text, before + _DAY, k)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def kind(text: Column, most: int = 2000) -> Column:
    """Kind of certificate by the signs in the first ``most`` characters."""
    head, scores = F.left(text, F.lit(most)), []
    for k, (name, signs) in enumerate(KINDS.items()):
        score = F.lit(0)
        for sign in signs:
            score = score + F.when(head.rlike(sign), 1).otherwise(0)
        scores.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    best = F.greatest(*scores)
    return F.when(best["score"] > 0, best["name"]).otherwise(list(KINDS)[-1])


def fields(text: Column) -> Column:
    """Struct of a certificate's fields; what isn't found is null, null text counts as blank.

    ``valid_from`` and ``valid_to`` are the ends of a term written as a range; a single date is the end. The name is the longest
    one behind a label of names, else the holder's.
    """
    text = F.coalesce(text, F.lit(""))
    holder = F.coalesce(*[F.when(~F.coalesce(_first(text, p), F.lit("0")).rlike(r"\d"), _first(text, p)) for p in HOLDERS])
    number = _first(text, *NUMBERS)
    credit = _first(text, r"(?<![0-9A-Za-z])([0-9A-Z]{18})(?![0-9A-Za-z])")
    names = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[^\n：:]{0,20}名称\s*[：:]\s*([^\n]{3,50})"), 1), lambda x: F.trim(x))
    longest = F.get(F.array_sort(F.transform(names, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("name")))), F.lit(0))["name"]
    end = lambda c: F.regexp_replace(c, "[。,，]+$", "")
    return F.struct(
        kind(text).alias("certificate_type"), F.coalesce(longest, holder).alias("name"), holder.alias("person_name"),
        F.upper(_first(text, r"(?<!\d)(\d{17}[\dXx])(?![0-9A-Za-z])")).alias("id_number"),
        F.when(F.coalesce(F.length(number), F.lit(0)) > F.coalesce(F.length(credit), F.lit(0)), number).otherwise(credit).alias("certificate_no"), number.alias("construction_no"),
        _named(text, TITLES).alias("title"), _named(text, LEVELS).alias("level"), end(labelled_field(text, PLACES, 30)).alias("registered_city"),
        _day(text, r"有效期限?[：:\s自]*(?=" + _DAY.replace("(\\d", "(?:\\d") + r"\s*[至\-~到])").alias("valid_from"),
        F.coalesce(_day(text, r"有效期[^\n]{0,24}?[至到~]\s*"), _day(text, r"至\s*"), _day(text, r"有效期[：:\s]*")).alias("valid_to"),
        end(labelled_field(text, ISSUERS, 30)).alias("issuer"), end(labelled_field(text, ADDRESSES, 50)).alias("address"), labelled_field(text, PERSONS, 10).alias("legal_person"),
    )
