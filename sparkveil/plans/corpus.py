"""Cases of this engine's own, on which its figures are taken: invented texts, names, addresses and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K

P, O, A, E, T, M = K.PERSON, K.ORGANIZATION, K.ADDRESS, K.EMAIL, K.PHONE, K.MYNUMBER


def number(first11: str, off: int = 0) -> str:
    """Twelve digits whose last is right, or wrong by `off`."""
    r = sum(int(c) * w for c, w in zip(reversed(first11), K.CHECK_WEIGHTS, strict=True)) % 11
    return first11 + str(((0 if r <= 1 else 11 - r) + off) % 10)


#: Known clients: (name, type, aliases).
ENTRIES = [("アサギ工房", O, ["アサギ本舗"]), ("ルリ物産", O, []), ("株式会社コハク電機", O, ["コハクD"]), ("ヒスイ・ロジ", O, []), ("月見ヶ丘書房", O, ["TSUKIMI BOOKS"])]

_N1, _N2, _N3 = number("20481632641"), number("13579246801"), number("98765012345")
_BLOCK = "株式会社ハルカゼ商会の榎様（haru@example.jp、03-5550-0101）へ送付済み。\n"

#: (category, text, entities as (surface, type) or (surface, type, nth)); an entity without nth stands for all its places.
CASES: list[tuple[str, str, list[tuple]]] = [
    ("org-prefix", "本日、株式会社ハルカゼ商会と打ち合わせ。", [("株式会社ハルカゼ商会", O)]),
    ("org-prefix", "発注先は有限会社ミナト印刷です。", [("有限会社ミナト印刷", O)]),
    ("org-prefix", "合同会社Nagisa Worksではなく合同会社ナギサへ。", [("合同会社Nagisa", O), ("合同会社ナギサ", O)]),
    ("org-prefix", "一般社団法人ソラ研究会より案内が届いた。", [("一般社団法人ソラ研究会", O)]),
    ("org-prefix", "医療法人アオバ会を訪問する。", [("医療法人アオバ会", O)]),
    ("org-prefix", "学校法人ツユクサ学園、および社会福祉法人ヒナタ会。", [("学校法人ツユクサ学園", O), ("社会福祉法人ヒナタ会", O)]),
    ("org-suffix", "先方のユズリハ企画株式会社から見積を受領。", [("ユズリハ企画株式会社", O)]),
    ("org-suffix", "請求書は「ワカバ出版有限会社」宛。", [("ワカバ出版有限会社", O)]),
    ("org-suffix", "Kisaragi合同会社の件。", [("Kisaragi合同会社", O)]),
    ("org-suffix", "これはミズナラ家具合資会社が作った。", [("ミズナラ家具合資会社", O)]),
    ("org-suffix", "シラカバ食品株式会社、クスノキ化学株式会社の二社。", [("シラカバ食品株式会社", O), ("クスノキ化学株式会社", O)]),
    ("org-abbr", "(株)ツバキ製作所へ再送。", [("(株)ツバキ製作所", O)]),
    ("org-abbr", "納品元：カエデ建設(株)", [("カエデ建設(株)", O)]),
    ("org-abbr", "(有)ナデシコ薬局の在庫を確認。", [("(有)ナデシコ薬局", O)]),
    ("org-abbr", "支払いはアカネ繊維(有)から。", [("アカネ繊維(有)", O)]),
    ("org-glyph", "㈱スズカゼ印刷に依頼した。", [("㈱スズカゼ印刷", O)]),
    ("org-glyph", "担当はハナミズキ書店㈱です。", [("ハナミズキ書店㈱", O)]),
    ("org-glyph", "㈲ソラマメ通信へ電話する。", [("㈲ソラマメ通信", O)]),
    ("org-fullwidth", "（株）ホシゾラ観光の見積。", [("（株）ホシゾラ観光", O)]),
    ("org-fullwidth", "株式会社ＡＢＣ商事を訪ねた。", [("株式会社ＡＢＣ商事", O)]),
    ("org-fullwidth", "ＮＰＯ法人ミドリの件は別途。", [("ＮＰＯ法人ミドリ", O)]),
    ("org-core", "アサギ工房から返信があった。", [("アサギ工房", O)]),
    ("org-core", "昨日はルリ物産とコハク電機を回った。", [("ルリ物産", O), ("コハク電機", O)]),
    ("org-core", "コハクDの担当に確認。", [("コハクD", O)]),
    ("org-core", "月見ヶ丘書房とTSUKIMI BOOKSは同じ会社。", [("月見ヶ丘書房", O), ("TSUKIMI BOOKS", O)]),
    ("org-core", "アサギ本舗の名で届いている。", [("アサギ本舗", O)]),
    ("dict-variant", "ヒスイ･ロジの便で届く。", [("ヒスイ･ロジ", O)]),
    ("dict-variant", "ア サ ギ 工 房と書かれていた。", [("ア サ ギ 工 房", O)]),
    ("dict-variant", "ｱｻｷﾞ工房ではなくルリ　物産。", [("ルリ　物産", O)]),
    ("dict-variant", "tsukimiではなくＴＳＵＫＩＭＩ ＢＯＯＫＳと表記。", [("ＴＳＵＫＩＭＩ ＢＯＯＫＳ", O)]),
    ("person-kanji", "青柳様がいらっしゃいます。", [("青柳", P)]),
    ("person-kanji", "担当の石清水さんに伝えて。", [("石清水", P)]),
    ("person-kanji", "明日、卯月部長と会う。", [("卯月", P)]),
    ("person-kanji", "それは榎氏の意見だ。", [("榎", P)]),
    ("person-kanji", "小野寺先生と東雲課長が出席。", [("小野寺", P), ("東雲", P)]),
    ("person-kanji", "宛先は神無月殿とする。", [("神無月", P)]),
    ("person-kanji", "久遠社長、桜庭専務の順に。", [("久遠", P), ("桜庭", P)]),
    ("person-kana", "マリアさんから電話。", [("マリア", P)]),
    ("person-kana", "ルイス様のご予約。", [("ルイス", P)]),
    ("person-kana", "エマ主任へ回送。", [("エマ", P)]),
    ("person-kana", "Kim氏とアンナ様。", [("Kim", P), ("アンナ", P)]),
    ("person-dept", "営業部高千穂様あてに発送。", [("高千穂", P)]),
    ("person-dept", "人事課千早さん、総務室常盤氏。", [("千早", P), ("常盤", P)]),
    ("trap-role", "担当者様へお渡しください。", []),
    ("trap-role", "お客様、皆様、関係者様へ。", []),
    ("trap-person", "皆さんで話し合う。", []),
    ("trap-person", "おばあさんの昔話。", []),
    ("trap-person", "客様は神様ではない。", [("神", P)]),
    ("trap-org", "株式会社の設立手続き。", []),
    ("trap-org", "御中と書く位置について。", []),
    ("trap-loc", "東京都の気候は温暖だ。", []),
    ("trap-loc", "大阪府と京都府を比べる。", []),
    ("trap-loc", "北海道は広い。", []),
    ("trap-loc", "神奈川県へ出張した。", []),
    ("trap-phone", "会議は2031-04-05の10:30から。", []),
    ("trap-phone", "型番は12-345-6789です。", []),
    ("phone", "電話は03-5550-0100まで。", [("03-5550-0100", T)]),
    ("phone", "携帯090-5550-1234へ。", [("090-5550-1234", T)]),
    ("phone", "0120-555-012が窓口。", [("0120-555-012", T)]),
    ("phone", "山間の局番04999-5-0123も拾う。", [("04999-5-0123", T)]),
    ("phone", "06-5550-0199と050-5550-7788。", [("06-5550-0199", T), ("050-5550-7788", T)]),
    ("phone-fullwidth", "ＴＥＬ：０３－５５５０－０１０２", [("０３－５５５０－０１０２", T)]),
    ("phone-hyphen", "080ー5550ー3456に連絡。", [("080ー5550ー3456", T)]),
    ("phone-hyphen", "045−555−0187が代表。", [("045−555−0187", T)]),
    ("phone-plain", "09055501234に折り返す。", [("09055501234", T)]),
    ("email", "連絡はharu.kaze@example.co.jpまで。", [("haru.kaze@example.co.jp", E)]),
    ("email", "a_b+c@mail.example.org と info@example.com の両方。", [("a_b+c@mail.example.org", E), ("info@example.com", E)]),
    ("email-fullwidth", "ｓｏｒａ＠ｅｘａｍｐｌｅ．ｊｐへ。", [("ｓｏｒａ＠ｅｘａｍｐｌｅ．ｊｐ", E)]),
    ("email-mixed", "宛先：mina.to＠example.jp、件名は未定。", [("mina.to＠example.jp", E)]),
    ("mynumber-valid", f"番号は{_N1}です。", [(_N1, M)]),
    ("mynumber-valid", f"{_N2}と{_N3}を照合。", [(_N2, M), (_N3, M)]),
    ("mynumber-valid", "個人番号　" + _N1.translate(str.maketrans("0123456789", "０１２３４５６７８９")) + "　提出済", [(_N1.translate(str.maketrans("0123456789", "０１２３４５６７８９")), M)]),
    ("mynumber-invalid", f"伝票{number('20481632641', 1)}は別物。", []),
    ("mynumber-invalid", f"長い{_N1}7も違う。", []),
    ("address", "〒100-0099 東京都青葉区旭町1-2-3にお送りください。", [("〒100-0099", A), ("東京都青葉区旭町1-2-3", A)]),
    ("address", "本社は神奈川県汐見市港町4-5です。", [("神奈川県汐見市港町4-5", A)]),
    ("address", "倉庫：北海道白樺郡大野町、開拓記念館そば。", [("北海道白樺郡大野町", A)]),
    ("core-propagation", "株式会社ハルカゼ商会は老舗。ハルカゼ商会の創業は古い。", [("株式会社ハルカゼ商会", O), ("ハルカゼ商会", O, 1)]),
    ("core-propagation", "ミナト印刷有限会社に発注。後日、ミナト印刷より納品。", [("ミナト印刷有限会社", O), ("ミナト印刷", O, 1)]),
    ("core-propagation", "青柳様に確認済み。青柳、と署名があった。", [("青柳", P)]),
    ("propagation-variant", "㈱ＡＢＣ工業と契約。ABC工業は来月移転する。", [("㈱ＡＢＣ工業", O), ("ABC工業", O)]),
    ("compound-trap", "株式会社ヒビキを訪問。ヒビキホールは別の施設。", [("株式会社ヒビキ", O)]),
    ("compound-trap", "榎さんは留守。榎本町の店に寄る。", [("榎", P, 0)]),
    ("mixed", "ユズリハ企画株式会社 営業部 榎様 enoki@example.jp 03-5550-0111", [("ユズリハ企画株式会社", O), ("榎", P), ("enoki@example.jp", E), ("03-5550-0111", T)]),
    ("mixed", "アサギ工房の青柳さん（080-5550-9876）が、大阪府青葉市旭町2-1へ移転と連絡。", [("アサギ工房", O), ("青柳", P), ("080-5550-9876", T), ("大阪府青葉市旭町2-1", A)]),
    ("mixed", "カエデ建設(株)御中\n桜庭部長\n拝啓、ルリ物産の件です。", [("カエデ建設(株)", O), ("桜庭", P), ("ルリ物産", O)]),
    ("mixed", "ツユクサ学園御中、千早先生", [("ツユクサ学園", O), ("千早", P)]),
    ("signature", "--\n東雲課長\n株式会社ハルカゼ商会\nTEL 03-5550-0123\nsino@example.jp", [("東雲", P), ("株式会社ハルカゼ商会", O), ("03-5550-0123", T), ("sino@example.jp", E)]),
    ("signature", "--\n常盤 一葉\nミナト印刷有限会社\n〒530-0099", [("常盤 一葉", P), ("ミナト印刷有限会社", O), ("〒530-0099", A)]),
    ("unknown-entity", "新しい取引先のカワセミとは初めて話す。", [("カワセミ", O)]),
    ("edge", "", []),
    ("edge", "！？…——※「」『』（）", []),
    ("edge", "Hello, 株式会社ナギサ! Привет, 榎様. 안녕", [("株式会社ナギサ", O), ("榎", P)]),
    ("edge", _BLOCK * 25, [("株式会社ハルカゼ商会", O), ("榎", P), ("haru@example.jp", E), ("03-5550-0101", T)]),
]


def cases(spark: SparkSession) -> DataFrame:
    """(id, category, text, entities, note)."""
    rows = []
    for i, (category, text, entities) in enumerate(CASES):
        for e in entities:
            if e[0] not in text or (len(e) > 2 and text.count(e[0]) <= e[2]):
                raise ValueError(f"case {i}: an entity isn't in its text")
        rows.append((f"c{i:03d}", category, text, [(e[0], e[1], e[2] if len(e) > 2 else None) for e in entities], ""))
    return spark.createDataFrame(rows, "id string, category string, text string, entities array<struct<surface:string,type:string,nth:int>>, note string")
