"""Types, labels, priorities and word lists."""

from __future__ import annotations

# They must be these for right results.

PERSON, ORGANIZATION, LOCATION, ADDRESS = "PERSON", "ORGANIZATION", "LOCATION", "ADDRESS"
EMAIL, PHONE, MYNUMBER = "EMAIL", "PHONE", "MYNUMBER"
TYPES = (PERSON, ORGANIZATION, LOCATION, ADDRESS, EMAIL, PHONE, MYNUMBER)

LABELS = {
    PERSON: "人名",
    ORGANIZATION: "組織",
    LOCATION: "地名",
    ADDRESS: "住所",
    EMAIL: "メール",
    PHONE: "電話",
    MYNUMBER: "マイナンバー",
}

PRIORITY = {"denylist": 40, "structural": 30, "address": 25, "regex": 20, "ner": 10, "llm": 5}

LEGAL_FORMS = (
    "特定非営利活動法人", "一般社団法人", "一般財団法人", "公益社団法人", "公益財団法人", "独立行政法人",
    "国立大学法人", "社会福祉法人", "株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "学校法人",
    "医療法人", "NPO法人", "(株)", "(有)",
)

PERSON_HONORIFICS = ("様", "さん", "氏", "殿", "先生", "部長", "課長", "係長", "主任", "社長", "専務", "常務", "取締役")
ORG_HONORIFICS = ("御中",)
PERSON_STOPWORDS = ("皆", "みな", "お客", "客", "奥", "各位")
GENERAL_STOPWORDS = ("担当者", "担当", "責任者", "関係者", "保護者", "第三者", "当社", "弊社", "貴社", "御社", "本人", "ご本人")
DEPARTMENT_ENDS = "部課係室局店社庁省科班組隊"

ORG_CHARS = "一-龥ァ-ヶー・&A-Za-z0-9々〆〇"
PERSON_CHARS = "一-龥ァ-ヶーA-Za-z々"
#: What continues a name: kanji with extensions A to F and compatibility forms, variation selectors, katakana, ASCII.
NAME_CHARS = r"㐀-䶿一-鿿豈-﫿\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}︀-️\x{E0100}-\x{E01EF}ァ-ヶーA-Za-z0-9々-〇"

HYPHENS = "-ー−‐―‒–—⁃－"
PHONE_HYPHENS = "-ー−‐―ｰ"

PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県",
    "東京都", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県",
    "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県",
    "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
CITY_MARKS = "市区町村郡"

#: Legal forms put before and behind a core name of the dictionary.
DICTIONARY_FORMS = ("株式会社", "有限会社", "(株)", "(有)")
MIN_CORE, MIN_SPREAD, MIN_CORE_SPREAD = 3, 2, 3
PERSON_MAX, ORG_MAX = 4, 24

CHECK_WEIGHTS = (2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6)

NER_LABELS = {
    PERSON: ("Person",),
    ORGANIZATION: (
        "Company", "Company_Group", "Corporation_Other", "Organization_Other", "International_Organization", "Government",
        "Cabinet", "Military", "Political_Organization_Other", "Political_Party", "Political_Organization",
        "Sports_Organization_Other", "Pro_Sports_Organization", "Sports_League", "Sports_Team", "Show_Organization",
        "Nonprofit_Organization", "Ethnic_Group_Other", "Nationality", "Family",
    ),
    LOCATION: (
        "City", "County", "Province", "Country", "GPE_Other", "Region_Other", "Geological_Region_Other", "Continental_Region",
        "Domestic_Region", "Address", "Postal_Address", "Location_Other", "Mountain", "Island", "River", "Lake", "Sea", "Bay",
        "Canal", "Spa",
    ),
}

# End of fixed values.

#: White space as Python's str.isspace sees it, for a Java character class.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0  -     　"

SPAN = "struct<start:int,end:int,type:string,score:double,sources:array<string>>"
SPANS = f"array<{SPAN}>"
REPORT = "array<struct<original:string,token:string,type:string,sources:array<string>>>"
