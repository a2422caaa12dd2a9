"""Values that results depend on, as text."""

# Entity types, fates, strategies, thresholds.
ENTITY_TYPES = ["zh_person_name", "zh_phone", "zh_id_card", "zh_bank_card", "zh_address", "email", "ip_address", "date", "api_key", "password", "token", "plate", "url", "us_ssn", "credit_card"]
IRREVERSIBLE = ["api_key", "password", "token"]
SIMULATABLE = ["zh_person_name", "zh_phone", "zh_id_card", "zh_bank_card", "zh_address", "email", "ip_address", "date"]
THRESHOLDS = {"zh_person_name": 0.5, "zh_phone": 0.8, "zh_id_card": 0.9, "zh_bank_card": 0.9, "zh_address": 0.6, "email": 0.7}
DEFAULT_THRESHOLD = 0.5
REDACTED = "[REDACTED]"

# Formats.
PHONE_PREFIXES = "130 131 132 133 134 135 136 137 138 139 145 146 147 148 149 150 151 152 153 155 156 157 158 159 166 167 170 171 172 173 174 175 176 177 178 179 180 181 182 183 184 185 186 187 188 189 190 191 192 193 195 196 197 198 199".split()
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_CHECKS = "10X98765432"
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳唐罗薛雷贺倪汤滕殷毕郝邬安常乐于时傅皮齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫房解应丁宣邓郁单杭洪包诸左石崔吉钮龚程嵇邢滑裴陆荣翁荀羊甄封芮储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲宫宁仇栾暴甘厉戎祖武符刘景詹束龙叶幸司韶黎蓟薄印宿白怀蒲从鄂索咸籍赖卓蔺屠池乔曾牛关燕文辛"
DOUBLE_SURNAMES = "欧阳 司马 上官 诸葛 东方 独孤 南宫 万俟 闻人 夏侯 赫连 皇甫 尉迟 公孙 慕容 长孙 宇文 司徒 轩辕 令狐 呼延".split()
PARTICLES = "的了是在把被让不这那个些们吗呢吧就都也还很没给对从向该其并则等或而由及与为以之"
SEPARATORS = "-_ \u00a0·•–—"

# Patterns. WORD stands for an ASCII word boundary, as the three patterns that need it expect.
WORD = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PHONE = "1[3-9][0-9]{9}"
ID_18 = "[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]"
ID_15 = "[1-9][0-9]{7}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}"
CARD = "[0-9]{13,19}"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
DATE = "(?:19|20)[0-9]{2}[-/.年](?:0?[1-9]|1[0-2])[-/.月](?:3[01]|[12][0-9]|0?[1-9])日?"
PLATE = "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Z][A-HJ-NP-Z0-9]{4,6}"
URL_BODY = r"[^ \t\n\f\r<>\"'{}\\^`]+[A-Za-z0-9/~#=&_\-+]"
URL = rf"(?:https?|ftp)://{URL_BODY}"
SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
API_KEY = r"(?:sk|pk|api|ak)-[A-Za-z0-9_\-]{16,}"
JWT = r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
KEY_WORDS = r"(?:api[_\-]?key|secret|password|passwd|pwd|token|access[_\-]?key)"
KEY_JOINT = r"[ \t\n\f\r]*[:=][ \t\n\f\r]*[\"']?"
KEY_VALUE = r"[A-Za-z0-9_\-.]{8,}"
NAME_CUE = "(?:我叫|姓名|名字是|客户|联系人|收件人|负责人|申请人|用户|病人|患者|就诊人|员工|同学|本人|我是)[ \t\n\f\r]*[:：是为]?[ \t\n\f\r]*"
NAME = "[一-龥]{2,4}"
NAME_TITLE = "(?:先生|女士|小姐|老师|医生|同学|工程师|经理|总监)"
PLATE_CUE = r"(?i:(?:license|vehicle|registration)[ \t\n\f\r]+plate(?:[ \t\n\f\r]+number)?[ \t\n\f\r]*[:#]?[ \t\n\f\r]*)"
PLATE_EN = "[A-Z]{2,3}-?[0-9]{3,4}[A-Z]?"
PLATE_CA = "[0-9][A-Z]{3}[0-9]{3}"
ADDRESS = "(?:[一-龥]{2,8}(?:省|自治区)|(?:北京市|上海市|天津市|重庆市))[一-龥]{2,12}(?:市|区|县|旗|盟)[一-龥]{2,20}(?:路|街|道|大街|大道|胡同|里|弄|巷|村|镇|园区|工业园)[0-9]*[号院栋楼室单元层]*"
PHONE_COUNTRY = r"(?:\+|00)?86[ \-]?1[3-9](?:[ \-]?[0-9]){9}"
PHONE_DOTTED = r"1[3-9][0-9]\.[0-9]{4}\.[0-9]{4}"
