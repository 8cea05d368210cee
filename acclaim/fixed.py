"""Fixed values the results depend on, written out as plain text.

Everything in this module is data: word lists, thresholds and lookup rows that
must have exactly these values for the output to be right.  Each list is a
default that callers may replace by a parameter.  No logic lives here.
"""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return text.split()


def _phrases(text: str) -> list[str]:
    return [line.strip() for line in text.strip().splitlines() if line.strip()]


# --- fixed values: sentence splitting --------------------------------------
ABBREVIATIONS = _words(
    "e.g i.e vs etc Fig Figs Eq Eqs Ref Refs Vol No Dr Prof Mr Mrs Jr Sr "
    "Inc Ltd Corp approx ca cf viz"
)
MONTHS_SHORT = _words("Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec")
MONTHS = _words(
    "January February March April May June July August September October November December"
) + MONTHS_SHORT
MIN_SENTENCE_CHARS = 5

# --- fixed values: line-break hyphen repair ---------------------------------
STANDALONE_SHORT_WORDS = _words(
    "in on at to by up or an as is it be do go if no so we he of ox ion and the "
    "for but not are was has had can may its"
)

# --- fixed values: self terms (the marker phrases are in data/markers.txt) ----
SELF_TERMS_EN = _phrases(
    """
    our group
    our team
    our laboratory
    our lab
    our previous work
    our earlier work
    our recent work
    our study
    we
    us
    ourselves
    the present authors
    the authors
    by the authors
    """
)
SELF_TERMS_ZH = _words("本课题组 本团队 本实验室 本研究组 我们 笔者 作者本人")

# --- fixed values: canonical markers ----------------------------------------
STRIPPABLE_VERBS = _words(
    "reported proposed discovered described published demonstrated suggested provided used introduced "
    "developed applied identified established synthesized observed detected measured presented noted "
    "shown found studied investigated examined explored revealed confirmed verified documented"
)
MARKER_EDGE_PREFIXES = _words(
    "was were is are been being have has had the a an by in on at to for with of from that which who it"
)
MARKER_EDGE_SUFFIXES = _words("by in on at to for with of from that the a an as")

# --- fixed values: author mentions ------------------------------------------
NOT_AUTHOR_WORDS = _words(
    "January February March April May June July August September October November December "
    "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec "
    "Table Tables Figure Figures Fig Figs Section Sections Chapter Chapters Equation Equations Eq Eqs "
    "Theorem Theorems Lemma Lemmas Appendix Abstract Introduction Method Methods Result Results Discussion "
    "Conclusion Conclusions Acknowledgment Acknowledgments Acknowledgement Acknowledgements Supplementary "
    "Supporting Electronic Online The This That These Those Here There However Although Because Since While "
    "When Where Which Furthermore Moreover Therefore Thus Hence Meanwhile Recently Generally Typically "
    "Notably Importantly Specifically Interestingly Surprisingly Unfortunately Similarly Conversely "
    "Additionally Alternatively For And But With From Into Over After Before During Between Among Through "
    "Ref Refs Vol No DNA RNA ATP NMR XRD SEM TEM AFM UV IR MS GC HPLC NaOH HCl China Japan Korea India "
    "Germany France England America Europe Asia Africa United States Kingdom University Institute "
    "Laboratory Center Department Journal Science Nature Chemical Physical International National American "
    "European Chinese New All Each Some Many Most Several Various First Second Third Next Last In On At By "
    "To Of It As So If Based According Compared Due Given Using Note Data Both Such Other Total Aqueous"
)
NOT_NAME_TAIL_ZH = "的了在是不有这和与或而且也都把被将其那就着要能说会没还如但上下大小多少面向时"
NAME_LEAD_ZH = "由被据经与和对按"
NAME_PARTICLES = _words("van von de del della der den di la le el al bin ibn")
PLACEHOLDER_AUTHORS = ["et al.", "et al", "et.al.", "et.al"]

# --- fixed values: veto 1 ----------------------------------------------------
PASSIVE_MARKER_WORDS = (
    "first|firstly|initially|originally|earliest|novel(?:ly)?|pioneered?|introduced|developed|proposed|established"
)

# --- fixed values: page furniture and titles ---------------------------------
ARTICLE_LABELS = [
    "REVIEW ARTICLE", "RESEARCH ARTICLE", "ORIGINAL ARTICLE", "LETTER", "COMMUNICATION", "SHORT COMMUNICATION",
]
SECTION_WORDS = _words(
    "introduction methods results discussion conclusions background methodology experiment experimental "
    "materials overview theory model analysis"
)

# --- fixed values: words of an affiliation line -------------------------------
INSTITUTION_WORDS = _words("Department Institute University School Center College Laboratory Faculty")

# --- fixed values: register header and form labels ---------------------------
REGISTER_HEADERS_ZH = _phrases(
    """
    编号
    施评文献全部信息
    施评文献第一作者
    施评文献其他作者
    施评文章名
    施评期刊年卷期页码
    施评期刊
    施评年份
    施评卷期起止页码
    施评文献第一作者机构
    施评国家（第一作者）
    评论句
    标志词
    被评文献全部信息
    被评文献第一作者
    被评文献其他作者
    被评文章名
    被评期刊年卷期起止页码
    被评期刊全称
    被评年份
    被评卷期起止页码
    被评文献第一作者机构
    被评国家（第一作者）
    其他被评文献
    提供者
    备注
    """
)
FORM_TITLE = "2026年学术评论句登记表"
FORM_FOOTER = "其他：你这个评论句有（/）个被评文献，请提供另（/）张登记表。【注意重新提交修正后的Excel表、登记表及原文】"
FORM_LABELS = _phrases(
    """
    施评文献作者
    期刊名称，年，卷，期，页
    机构中文名称
    机构英文名称
    中文题目
    英文题目
    论文关键词
    题目关键词
    学术评论句
    被评文献
    其他被评文献
    被评作者机构
    标志词
    提供者
    """
)

# --- fixed values: labels of a judge request ----------------------------------
JUDGE_LABELS = {
    "id": "候选句 #",
    "sentence": "  原文: ",
    "marker": "  标志词: ",
    "author": "  被评作者: ",
    "year": "  年份: ",
    "reference": "  匹配参考文献: ",
    "before": "  上下文(前): ",
    "after": "  上下文(后): ",
}
JUDGE_BATCH = 20
VERIFY_BATCH = 10
# characters quoted of a reference or neighbour, of a sentence to verify, in a report and in an audit
JUDGE_QUOTE, VERIFY_QUOTE, REPORT_QUOTE, AUDIT_QUOTE = 200, 300, 120, 80

# --- fixed values: country gazetteer, in priority order ----------------------
# country: keyword, keyword, ...
COUNTRIES = _phrases(
    """
    中国: China, 中国, Taiwan, Hong Kong
    美国: USA, United States, U.S.A, America, U.S.
    英国: United Kingdom, UK, England, Scotland, Wales
    日本: Japan
    韩国: Korea
    德国: Germany, Deutschland
    法国: France
    澳大利亚: Australia
    加拿大: Canada
    印度: India
    新加坡: Singapore
    荷兰: Netherlands, Holland
    瑞士: Switzerland
    意大利: Italy
    西班牙: Spain
    巴西: Brazil
    俄罗斯: Russia
    新西兰: New Zealand
    瑞典: Sweden
    以色列: Israel
    丹麦: Denmark
    挪威: Norway
    芬兰: Finland
    奥地利: Austria
    比利时: Belgium
    波兰: Poland
    葡萄牙: Portugal
    爱尔兰: Ireland
    沙特阿拉伯: Saudi Arabia
    伊朗: Iran
    土耳其: Turkey, Türkiye
    泰国: Thailand
    马来西亚: Malaysia
    越南: Vietnam
    巴基斯坦: Pakistan
    埃及: Egypt
    南非: South Africa
    墨西哥: Mexico
    阿根廷: Argentina
    智利: Chile
    捷克: Czech
    匈牙利: Hungary
    希腊: Greece
    孟加拉国: Bangladesh
    印度尼西亚: Indonesia
    菲律宾: Philippines
    """
)
# Cities are tried after every country keyword.
CITIES = _phrases(
    """
    中国: Beijing, Shanghai, Guangzhou, Shenzhen, Nanjing, Wuhan, Xi'an, Chengdu, Hangzhou, Tianjin, Harbin, Dalian, Changsha, Hefei, Jinan, Kunming, Lanzhou, Fuzhou, Xiamen
    日本: Tokyo, Osaka, Kyoto
    韩国: Seoul, Busan
    德国: Berlin, Munich, Hamburg
    英国: London, Oxford, Cambridge
    法国: Paris, Lyon
    澳大利亚: Sydney, Melbourne
    加拿大: Toronto, Montreal, Vancouver
    印度: Mumbai, Delhi
    荷兰: Amsterdam
    瑞士: Zurich, ETH
    意大利: Rome, Milan
    西班牙: Madrid, Barcelona
    俄罗斯: Moscow
    瑞典: Stockholm
    奥地利: Vienna
    """
)
POSTCODE_PROVINCES = "jiangsu|zhejiang|guangdong|shandong|hubei|sichuan|henan"
