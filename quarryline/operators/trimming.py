"""Cutting navigation and closing parts of page texts by ordered rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules in order, (pattern, options). Start rules remove what they match at the start; end rules cut from a mark to the end.
START = (
    (r"^[\s]*(?:首页|主页|Home)\s+", "i"), (r"^[\s]*会员登录\s+会员注册\s+", "i"), (r"^[\s]*[一-龥]{2,4}\s+[一-龥]{2,4}\s+[一-龥]{2,4}\s+", "i"),
)
MIDDLE = (
    (r"\n\s*普通VIP年卡可用\s*", "is"), (r"\n\s*关注\s+关注\s+", "is"), (r"\n\s*\d+\s+点赞\s+", "is"), (r"\n\s*踩\s+", "is"), (r"\n\s*\d+\s+收藏\s+", "is"),
    (r"\n\s*觉得还不错\?.*?一键收藏\s*", "is"), (r"\n\s*0\s+评论\s+", "is"), (r"\n\s*分享\s+复制链接.*?举报\s+", "is"), (r"\n\s*扫一扫\s+", "is"), (r"\n\s*举报\s+举报\s*", "is"),
)
END = (
    (r"\s*相关文章\s.*?$", "is"), (r"\s*月点击排行\s.*?$", "is"), (r"\s*关于本站\s.*?$", "is"), (r"\s*版权声明\s.*?$", "is"), (r"\s*Copyright\s.*?$", "is"), (r"\s*(?:还没有人评论|请先登录).*?$", "is"),
    (r"\s*分享\s.*?收藏\s.*?$", "is"), (r"\s*\d+条评论\s.*?$", "is"), (r"\s*阅读原文\s*$", "is"), (r"\s+阅读原文\s+.*?$", "is"), (r"\s*参与评论\s.*?$", "is"), (r"\s*热门推荐\s.*?$", "is"), (r"\s*最新发布\s.*?$", "is"),
    (r"\s*关于我们\s.*?$", "is"), (r"\s*招贤纳士\s.*?$", "is"), (r"\s*商务合作\s.*?$", "is"), (r"\s*寻求报道\s.*?$", "is"), (r"\s*在线客服\s.*?$", "is"), (r"\s*工作时间\s.*?$", "is"), (r"\s*公安备案号.*?$", "is"),
)
ICONS = r"[\x{e600}-\x{e900}]+"


def apply_rules(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The rules applied one after the other; each removes what it matches."""
    for pattern, options in rules:
        c = F.regexp_replace(c, f"(?{options}){pattern}", "")
    return c


def trim_page(c: Column) -> Column:
    """Text between the page's navigation and its closing parts; null stays null."""
    c = apply_rules(apply_rules(apply_rules(c, START), MIDDLE), END)
    c = F.when(F.length(c) > 500, F.regexp_replace(c, r"(?s)^(.{301,}?)\n\s*参与评论\s.*$", "$1")).otherwise(c)
    return F.trim(F.regexp_replace(c, ICONS, ""))
