"""Rule tables of scores and filters (fixed values), and their column expressions."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scoring of search results.
APP = ("app下载", "应用下载", "软件下载", "安卓版", "安装包", "sj.qq.com", "appdetail", "32r.com", "duote.com", "多多软件", "华军软件", "应用宝", "play.google.com")
PROMO = ("官方旗舰店", "优惠券", "折扣", "促销", "秒杀")
OFFICIAL = ("python.org", "pypi.org", "github.com", "gitee.com", "readthedocs", "官方文档", "documentation", "說明文件", "参考手册", "开发文档")
SOURCES = (
    (r"stack\s*overflow", 9.5), (r"real\s*python", 9.0), ("infoq", 8.5), ("掘金", 8.0), ("juejin", 8.0), ("segmentfault", 8.0), ("思否", 8.0), ("csdn", 7.5),
    ("知乎", 7.0), ("zhihu", 7.0), ("菜鸟教程", 6.5), ("runoob", 6.5), ("博客园", 6.0), ("cnblogs", 6.0), ("脚本之家", 5.5), ("jb51", 5.5),
)
INSTITUTION = (".gov.cn", ".edu.cn", "官方")
VIDEO = ("bilibili", "哔哩哔哩", "youtube", "优酷")
VIDEO_LESSON = ("教程", "tutorial", "讲解", "入门", "完整")
LOW = ("百度文库", "百度知道", "贴吧", "文库精选")
VALUE = ("教程", "tutorial", "指南", "guide", "详解", "入门", "完整", "实战", "案例", "示例", "最佳实践", "全攻略")
QA = ("如何", "怎么", "解决", "问题", "错误", "报错", "bug", "方法")
BASE = 5.0

# Hosts left out of a search and of fetching.
SEARCH_SKIP = (
    "bilibili.com", "www.bilibili.com", "youtube.com", "youtu.be", "youku.com", "v.youku.com", "iqiyi.com", "www.iqiyi.com", "qq.com/video", "v.qq.com",
    "douyin.com", "www.douyin.com", "kuaishou.com", "www.kuaishou.com", "acfun.cn", "www.acfun.cn", "ted.com", "image.baidu.com", "tupian.baidu.com",
    "images.baidu.com", "pixiv.net", "unsplash.com", "pinterest.com", "instagram.com", "flickr.com", "download.csdn.net", "pan.baidu.com", "wenku.baidu.com",
    "music.163.com", "weibo.com",
)
FETCH_SKIP = (
    "bilibili.com", "youtube.com", "youtu.be", "youku.com", "iqiyi.com", "v.qq.com", "douyin.com", "kuaishou.com", "acfun.cn", "ted.com", "image.baidu.com",
    "images.baidu.com", "pixiv.net", "unsplash.com", "pinterest.com", "instagram.com", "download.csdn.net", "pan.baidu.com", "wenku.baidu.com",
)

# Signs of crawl blocks, of redirects, of files without text, of trash folders.
BLOCKED = ("验证码", "请输入验证码", "访问过于频繁", "滑块验证", "security check", "cloudflare", "访问被拒绝", "access denied")
REDIRECT = ("baidu.com/link", "baidu.com/baidu.php", "google.com/url", "redirect", "jump")
NO_TEXT = (
    ".ppt", ".pptx", ".key", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".mp4", ".mov", ".avi", ".mkv", ".flv", ".wmv", ".mp3", ".wav", ".flac", ".aac",
    ".zip", ".rar", ".7z", ".tar", ".gz", ".exe", ".dmg", ".apk", ".ipa",
)
TRASH = ("回收站", "trash", "已删除", ".trash")
DOC_PREFIX = ("doc", "dox", "box", "sht", "wik")


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text contains one of the parts; false for null."""
    return F.coalesce(reduce(or_, [c.contains(p) for p in parts]), F.lit(False))


def base_score(text: Column) -> Column:
    """Score by source of a lower-case text: official, ordered sources, institutions, video, low, else 5."""
    c = F.when(any_of(text, OFFICIAL), 9.0)
    for pattern, score in SOURCES:
        c = c.when(text.rlike("(?iu)" + pattern), score)
    c = c.when(any_of(text, INSTITUTION), 8.5)
    c = c.when(any_of(text, VIDEO), F.when(any_of(text, VIDEO_LESSON), 6.5).otherwise(4.0))
    return c.when(any_of(text, LOW), 3.5).otherwise(BASE)


def quality_score(title: Column, abstract: Column, url: Column, query: str = "") -> Column:
    """Score from 0 to 10, with one decimal; null title, abstract and url count as empty."""
    title, abstract, url = (F.coalesce(x, F.lit("")) for x in (title, abstract, url))
    text = F.lower(F.concat(title, F.lit(" "), abstract))
    words = [w for w in query.lower().split() if len(w) > 1]
    bonus = F.when(any_of(text, VALUE), 0.8).otherwise(0.0) + F.when(any_of(text, QA), 0.3).otherwise(0.0)
    if words:
        hits = [sum((F.lower(x).contains(w).cast("int") for w in words), F.lit(0)) for x in (title, abstract)]
        part = hits[0] / len(words)
        bonus = bonus + F.when(part >= 0.8, 1.5).when(part >= 0.5, 0.8).otherwise(0.0) + F.when(hits[1] >= len(words) * 0.5, 0.5).otherwise(0.0)
    if any(ord(c) > 127 for c in query):
        bonus = bonus + F.when(title.rlike(r"[^\x00-\x7f]"), 0.3).otherwise(0.0)
    app = any_of(F.lower(url), APP) | any_of(text, APP)
    promo = any_of(text, PROMO) & ~text.contains("教程")
    return F.when(app, 0.5).when(promo, 1.0).otherwise(F.least(F.lit(10.0), F.round(base_score(text) + bonus, 1)))


def name_score(name: Column, path: Column, keyword: str) -> Column:
    """Equal 1.0, contains 0.8, path contains 0.5, else the part of the keyword's signs found in the name times 0.3."""
    k = keyword.lower()
    n, p = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    signs = sum((n.contains(ch).cast("int") for ch in k), F.lit(0)) / max(1, len(k)) * 0.3
    return F.when(n == k, 1.0).when(n.contains(k), 0.8).when(p.contains(k), 0.5).otherwise(F.round(signs, 6))


def crawl_block(body: Column, url: Column) -> Column:
    """Whether a page is a crawl block: by host first, then by phrases in body or url."""
    b, u = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    host_a = u.contains("security.zhihu.com") | u.contains("signin?next") | u.contains("captcha") | b.contains("访问过于频繁") | b.contains("人机验证")
    host_b = u.contains("baidu.com") & (u.contains("wappass.baidu.com") | b.contains("百度安全验证"))
    return F.when(u.contains("zhihu.com"), host_a).otherwise(host_b | any_of(b, BLOCKED) | any_of(u, BLOCKED))


def extension(name: Column) -> Column:
    """Extension of a file name with its dot, in lower case; empty for none and for names that only start with a dot."""
    return F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"[^./\\].*?(\.[^./\\]*)$", 1)


def item_kind(token: Column, node_type: Column) -> Column:
    """doc or folder, by node type (1 doc; 0 folder unless the token has a document's prefix), else by prefix."""
    is_doc = reduce(or_, [token.startswith(p) for p in DOC_PREFIX])
    return F.when(node_type == 1, "doc").when(is_doc, "doc").otherwise("folder")


def item_url(token: Column, url: Column, domain: str) -> Column:
    """Absolute url of a document: absolute as is, root-relative or path-prefixed on the domain, else by the token's prefix."""
    u = F.coalesce(url, F.lit(""))
    base = F.lit(domain)
    pathed = reduce(or_, [u.startswith(p) for p in ("file/", "docx/", "sheets/", "sheet/", "wiki/")])
    folder = F.when(token.startswith("sht"), "/sheets/").when(token.startswith("box"), "/file/").when(token.startswith("wik"), "/wiki/").otherwise("/docx/")
    return F.when(u.startswith("http"), u).when(u.startswith("/"), F.concat(base, u)).when(pathed, F.concat(base, F.lit("/"), u)).otherwise(F.concat(base, folder, token))
