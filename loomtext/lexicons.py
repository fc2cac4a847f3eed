"""Word lists and patterns that the rules use by default; every rule takes others."""

from __future__ import annotations

# Footers and credits with the most characters of their tails.
FOOTERS = (
    r"版权所有.{0,100}", r"版权归.{0,100}", r"未经许可.{0,100}", r"未经授权.{0,100}", r"转载请注明.{0,100}", r"转载请保留.{0,100}",
    r"本文来源.{0,100}", r"来源[:：].{0,80}", r"责任编辑[:：].{0,50}", r"编辑[:：].{0,50}", r"记者[:：].{0,50}", r"审校[:：].{0,50}",
    r"责编[:：].{0,50}", r"校对[:：].{0,50}", r"策划[:：].{0,50}", r"制作[:：].{0,50}", r"视觉[:：].{0,50}", r"图片来源[:：].{0,80}",
    r"图片由.{0,80}", r"资料来源[:：].{0,80}", r"本网站.{0,100}", r"本网页.{0,100}", r"本平台.{0,100}", r"免责声明.{0,200}",
)

# Marks that duplicate keys leave out, beside white space.
MARKS = "，。！？、；：,.!?;:\"'“”‘’（）()【】[]《》<>「」-—_"

# What a spreadsheet writes for a failed cell.
ERROR_VALUES = ("#NAME?", "#VALUE!", "#REF!", "#DIV/0!", "#N/A", "#NUM!", "#NULL!")

# Labels of a post's user interface.
UI_LABELS = ("O网页链接", "网页链接", "展开全文", "收起全文", "微博视频", "秒拍视频")
ARTICLE_LABEL, TRAILER = "发布了头条文章", "（本条新闻"

# The study's keywords.
KEYWORDS = ("婚姻", "结婚", "婚恋", "恋爱", "对象", "伴侣", "相亲", "单身", "不婚", "晚婚", "恐婚", "催婚", "婚姻登记", "彩礼", "离婚冷静期")
AMBIGUOUS_KEYWORD = "对象"

# Contexts in which the ambiguous keyword means a partner, or doesn't.
PARTNER = (
    "找对象", "介绍对象", "相亲对象", "结婚对象", "恋爱对象", "没有对象", "有对象", "谈对象", "处对象", "对象父母", "对象家人", "对象家长",
    "和对象", "跟对象", "与对象", "自己的对象", "另一半",
)
NO_PARTNER = (
    "研究对象", "调查对象", "服务对象", "帮扶对象", "救助对象", "管理对象", "监管对象", "执法对象", "保护对象", "援助对象", "资助对象", "扶持对象",
    "培训对象", "教育对象", "消费者对象", "采访对象", "采访的对象", "受访对象", "犯罪对象", "攻击对象", "制裁对象", "打击对象", "目标对象", "对象国",
    "对象企业", "对象地区", "对象群体", "对象人群",
)

# Terms of the post rules.
STRONG = ("婚姻", "结婚", "婚恋", "不婚", "晚婚", "恐婚", "催婚", "婚姻登记", "彩礼", "离婚冷静期")
WEAK = ("恋爱", "对象", "伴侣", "相亲", "单身")
CONTEXT = (
    "夫妻", "配偶", "丈夫", "妻子", "老公", "老婆", "男朋友", "女朋友", "男友", "女友", "领证", "婚礼", "婚后", "未婚", "已婚", "离婚",
    "再婚", "二婚", "求婚", "择偶", "脱单", "成家", "嫁人", "娶妻", "婚姻观", "恋爱观", "亲密关系", "父母催婚", "适婚年龄", "终身大事",
)
FIRST_PERSON = ("我", "我们", "本人", "自己")
ATTITUDE = (
    "觉得", "认为", "感觉", "希望", "想要", "不想", "愿意", "不愿意", "接受", "不能接受", "喜欢", "不喜欢", "害怕", "焦虑", "支持", "反对",
    "选择", "后悔", "压力", "自由", "幸福", "孤独",
)
AMBIGUOUS = (
    "研究对象", "实验对象", "调查对象", "服务对象", "适用对象", "目标对象", "招生对象", "招聘对象", "保障对象", "救助对象", "犯罪对象", "监测对象",
    "学习伴侣", "旅行伴侣", "智能伴侣", "AI伴侣", "宠物伴侣", "机器人伴侣", "单身公寓", "单身套餐", "单身房", "恋爱游戏", "恋爱综艺", "恋爱小说",
    "恋爱剧情", "恋爱漫画",
)
FICTION = ("小说", "阅读全文", "完结", "大结局", "晋江文学", "txt", "全章节")
EXCLUDED = ("微博问答", "超话", "恋与深空", "恋与制作人", "微博正文")
