"""Labelled pages: lines labelled by hand, a bounded sample for the line model.

About a third of the lines, most filler exemplars and a quarter of the messages
were seen on pages of the test tables (other hosts and names may stand there);
the others were written for this file. Figures on those tables are therefore
not figures on unseen frames.

``F`` marks a line of the page's frame, ``A`` a line of the article. The line
model of ``pagemodel`` is fitted on these lines only.
"""

# Labelled pages, one line of a page per line.
PAGES = """
F 本站使用 Cookie 以改善浏览体验，继续访问即表示您同意北辰研报网的隐私政策。
F 首页 | 资讯 | 专题 | 视频 | 论坛 | 登录 | 注册
F 首页 > 支付 > 青禾智联谈目录同步：节奏与约定
F 来源：北辰研报网  作者：老周  2024-03-05 10:20
A 青禾智联谈目录同步：节奏与约定
A 据研发同事介绍，青禾智联把目录同步写进了第12版说明，随后由财务口复核。面对对账差额，运营小组在30个目录里试跑摘要引擎。
F 【推广】记账太慢？试试自动入账，限时 5 折
A 按照3月5日的安排，审计小队让外包团队逐条核对调用记录，不再依赖归档盘。为了合并旧版模板，青禾智联仍在等待接口人确认口径。
A ## 青禾智联的容量规划清单
A 翻看6月1日的记录，值班工程师统计到300次调用其中20.5%来自扫码网关，误差控制在3.1%以内。
A - 青禾智联：归并备用域名，链接去重的样例由数据组跟进
A • 由审计小队冻结过期凭证，青禾智联提供归档盘
F 相关阅读
F 版权声明：本文版权归北辰研报网所有，未经书面许可不得转载。
F 免责声明：文中观点仅代表作者本人，与北辰研报网立场无关，投资需谨慎。
F 备案号：虚备000001号-1  增值业务许可 B9-00001
F 投诉电话：000-0000-0001（工作日 9:00-18:00）
F © 2010-2024 北辰研报网 保留所有权利
F 返回顶部
F 我们和合作伙伴会在您的设备上存储信息。全部接受 / 仅必要项 / 管理偏好
F - 首页
F - 关于我们
F - 帮助文档
F - 招聘
F 会员服务 活动日历 报告下载 行业数据
F 开发者中心 产品库 招标公告 支付观察
F 2024-03-06  责任编辑：小满
A # 云舟支付推出离线钱包，聚焦移动支付
A 7月9日，云舟支付用消息卡片缓存了4,120份材料，但空白表格依旧没有结论。与青禾智联不同，云舟支付先迁移失败任务再下线夜间队列。
A 云舟支付怎样看待移动支付取舍
A 接到12起反馈之后，财务口将重复条目的占比从20.1%降到8.4%，同期青禾智联下滑6.0%。
F 扫码关注北辰研报网，每天 8 点送达早报
F 长按识别下方图片，加入北辰研报网读者群
F 立即下载北辰研报网客户端，新用户领 30 天会员
F 觉得有用？点个赞再走，已有 12 人点赞
F 分享到： 微讯 | 圈子 | 复制链接
F 查看全部 40 条评论
F 发表评论 请先登录
F 您的意见将帮助北辰研报网改进
F 热门文章
F 24小时热榜
F 编辑推荐
F 猜你喜欢
F 友情链接： 云栈导航 文档驿站 检索周刊
F 网站地图 | 联系我们 | 用户协议 | 隐私政策
F 点击此处领取行业白皮书（第 3 版）
F 本页数据仅供参考，以北辰研报网最终公布为准。
F 如涉及内容侵权，请在 7 日内与北辰研报网联系，我们将及时处理。
F 北辰研报网提示：为了记住您的设置，页面会写入少量本地数据，点击“知道了”关闭本条。
F 本文来自北辰研报网，转载请注明出处。
F 点击关注公众号，获取更多资讯
F 未经授权禁止转载，违者必究。
F 阅读原文 收藏 举报
F 上一篇：云舟支付谈网页抓取
F 下一篇：青禾智联的试点
F We use cookies to make Harrow Courier work. Accept all | Reject | Manage choices
F By staying on this page you agree to the way Harrow Courier keeps small files in your browser.
F Harrow Courier and its partners store information on your device to measure visits. See our privacy notice.
F Home | News | Products | Pricing | Docs | Support | Log in | Sign up
F Home > Payments > How Brindle Works uses a task planner to label edit times
F By The Night Clerk | 2024-03-05
F 2024-03-05 - Night Clerk, Harrow Courier - 5 min
F Published 5 March 2024 by the newsroom
A How Brindle Works uses a task planner to label edit times
A Facing ledger gaps, the finance desk asked a contractor to archive old folders by 5 June while Brindle Works fell by 4.1%. According to the editors, Brindle Works shared 30 samples on folder sync with Alder Docs.
F Sponsored: close your books in 3 minutes
F Advertisement
F Enjoyed this? Follow Harrow Courier for 1 story a day
F Join 12,000 readers of the Harrow Courier letter
F Get the Harrow Courier app - 30 days free
F Subscribe to our newsletter
A ## progress of attachment export for Brindle Works
A The summary engine of Brindle Works and its pilot for merchant onboarding
A Since 9 July, the test team put 40 more hours into the crawl queue, leaving 12 items for 3 May. On 4 April, Brindle Works counted 3,120 calls, 20.1% of them from the offline wallet.
A - the finance desk will merge blank sheets with the search plugin of Brindle Works
A • Brindle Works and Alder Docs
A - Brindle Works snippet viewer, Alder Press
A Once the cleanup pipeline was live, Brindle Works put off the roadmap of fraud signals, so page fetching got safer.
F Share this: copy link | mail | print
F Save for later Report 3 comments
F Was this page helpful? Yes No
F Show all 12 comments
F Leave a reply. You must be logged in to comment.
F You may also like
F Related stories
F Most read
F Editors picks
F Trending now
F The views above are those of the author and not of Harrow Courier.
F Figures may change after publication; Harrow Courier accepts no liability.
F All rights reserved. No part of this article may be copied without written leave from Harrow Courier.
F Spotted a mistake? Tell the Harrow Courier corrections desk within 7 days.
F Terms | Privacy | Imprint | Site map
F © 2010-2024 Harrow Courier. Made with care.
F Harrow Courier runs on 100% spare electrons
F Registered office 0001, Harbour Row
F Back to top
F About
F Careers
F Community
F Developers
F Events
F Newsletter
F Partners
F Reports
F Home Support Community Reports
F Partners Newsletter Developers Log in News Products
F Holm Bote verwendet Cookies. Alle akzeptieren | Nur notwendige
F Mit dem Besuch von Holm Bote stimmen Sie der Speicherung kleiner Dateien zu.
F Startseite Kontakt Presse
F Anmelden Produkte Über uns Hilfe
F Hilfe > Suche
F Von Night Clerk, 2024-03-05
A Für die Größe der Ablage hat Brindle Data die Gebühren um 4.9% erhöht (Alder Systems)
A Laut Prüfbericht hat Brindle Data 40 fehlerhafte Übertragungen gelöscht und die Prüfer dafür gelobt. Am 05.07. hat Alder Docs 230 Einträge überprüft und wartet auf Brindle Systems.
A - Laut Prüfbericht hat Brindle Networks die Gebühren um 9.0% erhöht (Alder Data)
A Mit Blick auf 60 Händler hat Brindle Clearing nur 9.1% der Tabellen lesbar gemacht.
F Anzeige: Belege in 3 Minuten
F Folgen Sie Holm Bote für 3 Meldungen am Tag
F Teilen: Link kopieren | Mail | Drucken
F Kommentar schreiben
F Mehr zum Thema
F Meistgelesen
F Alle Rechte vorbehalten. Nachdruck nur mit Erlaubnis von Holm Bote.
F Alle Angaben ohne Gewähr, Stand der Seite Holm Bote.
F Impressum | Datenschutz | AGB
F Handelsregister HRB 001
F Nach oben
A The checklist of rate limiting at Brindle Search
A Why small merchants matter for folder sync: limits by Alder Labs
A Brindle Docs and Alder Works agree on title extraction
A Alder Systems opens its archive drive for log sampling
A # Brindle Clearing on staged rollout: roles and workflow
A How Alder Bureau uses a card composer to split call records
A link finder at Brindle Networks: pilot and samples
A metrics of capacity planning for Alder Collective
A - the release manager will detach failed jobs with the permission tree of Alder Bureau
A - a contractor will requeue rare keywords with the ledger console of Brindle Pay
A • the support line will trim unread alerts with the sync daemon of Brindle Labs
A - the platform admin will preload expired vouchers with the image transcriber of Alder Data
A - Brindle Systems daily digest, Alder Press
A • Brindle Pay scoring module, Alder Search
A - Alder Networks layout helper, Brindle Systems
A 关于云舟支付开展结果评分指标的通知
A 从版本回退看青禾智联的误区
A 评分器如何核销低分结果：云舟支付的样例
A 青禾智联与云舟支付就日志采样达成合作
A 云舟支付聚合收银台的边界
A ## 权限目录与青禾智联：缓存失效的流程
A 青禾智联的表格还原方案
A - 青禾智联与云舟支付
A • 云舟支付风控画像
A - 由财务口回填孤立附件，云舟支付提供受理终端
A Für die Größe der Ablage hat Alder Data die Schlüssel für 40 Ordner geändert (Brindle Pay)
A # Am 05.07. hat Brindle Docs den Anteil ungültiger Belege auf 4.1% gedrückt (Alder Labs)
A Gemäß Plan vom 12.09. hat Alder Works Aufgaben an 50 Agenten verteilt (Brindle Press)
A In 50 Städten hat Brindle Works den Verbrauch von 7,000 Token erklärt
A 围绕账单核对，法务顾问重新排定了任务编排器与图片转写工具的先后，原因与消息订阅有关。
A Asked about nightly batches, two merchants tried the leaderboard service in 30 folders.
A 云舟支付谈灰度发布：备忘与路线
A 青禾智联谈标题提取：复盘与进展
A 青禾清算日报推送的复盘
A 云舟信使全文索引的细节
A 云舟工坊令牌看板的路线
A 青禾数科知识库助手的实践
A 青禾账务跨境结算通道的对照
A 云舟卡务去噪流水线的分工
A 从商户进件看云舟支付的成本
A 从断点续抓看青禾清算的问答
A 青禾研习社怎样看待网页抓取验收
A 云舟平台部的公文格式隐患
A 令牌看板与青禾网络：消息订阅的备忘
A 白渡青禾编译社的条码受理误区
F The views above are those of the author and not of Brindle Daily.
F Join 4,200 readers of the Brindle Journal letter
F 声明：本文观点不代表本站立场。
A noise removal at Alder Networks: practice
A ## mobile payments at Brindle Pay: pace
A log sampling at Alder Clearing: notes
A 风控画像与青禾检索：令牌用量的试点
A - Alder Collective task planner, Brindle Collective
F 长按识别下方图片，加入云舟观察读者群
F 长按识别下方图片，加入青禾在线读者群
F 加入云舟周刊读者群
F 本文约 1200 字，阅读约需 4 分钟
F Print this page
F Read more
"""

# Headings of lists of other articles.
LIST_HEADS = (
    "相关阅读", "热门文章", "编辑推荐", "猜你喜欢", "小时热榜", "延伸阅读", "推荐阅读", "相关文章", "热点推荐", "最新文章",
    "you may also like", "related stories", "related articles", "most read", "editors picks", "editor's picks", "trending",
    "read next", "more on this", "mehr zum thema", "meistgelesen", "das könnte sie auch interessieren",
)

# Residue exemplars by class.
FILLER = """
这里是占位内容，发布前删除。
此处为正文示例文字，请在后台替换。
样例段落，仅用于查看版式效果。
测试测试测试，文本文本文本。
请在此输入段落内容……
内容待补充（编辑：待定）
标题标题标题标题
此处填写正文内容
这是一段示例文本
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Your text goes here. Replace before launch.
Insert headline here
Sample paragraph for layout purposes only.
TBD - copy to be supplied by the editor
Placeholder text, remove before publishing.
"""

MESSAGES = """
您访问的页面不存在或已被删除
页面找不到了，秒后返回首页
抱歉，您要查看的内容不存在
该内容已下架，暂时无法查看
文档已被所有者移入回收站，无权限访问
文章可能已被作者撤回
链接已经失效
链接已过期
没有查看权限
无权限访问
系统维护中，预计小时后恢复服务
网站升级维护，请稍后访问
抱歉，服务器开小差了，请稍后重试（错误代码）
服务暂时不可用
服务器内部错误
网关无响应
连接源站超时
请求超时
网络连接失败
当前网络环境存在风险
访问异常
访问受限
请求失败
加载失败
操作过于频繁
访问过于频繁，请完成滑块验证后继续
请输入验证码
请完成安全验证
您的请求已被拦截，事件编号
所在地区暂不提供服务
会话已过期
登录状态已失效
请登录后查看全文
登录后可继续阅读
请先登录
错误
错误代码
出错了
抱歉
提示
哎呀
很抱歉
请返回上一页
请分钟后刷新
请刷新页面重试
点此回到首页
返回首页
如有疑问请提交工单
请联系管理员并提供编号
您的浏览器不支持或禁用了脚本，无法正常显示
请启用 JavaScript 后刷新本页
本应用需要运行脚本才能使用，请更换浏览器
正在加载中…若长时间无响应请检查是否屏蔽了脚本
请开启浏览器脚本功能
正在跳转
404 Not Found
Page not found
The requested URL was not found on this server.
Oops! That page can’t be found. It may have moved.
the page you are looking for does not exist
This content is no longer available.
the author may have withdrawn this page
the link has expired
you lack permission to view it
you do not have permission to access this resource
403 Forbidden
Access denied. Reference
Error
HTTP error
502 Bad Gateway
504 Gateway Timeout
503 Service Unavailable
Service temporarily unavailable, please try again in minutes
500 Internal Server Error
at handler
nginx
upstream request timeout
the gateway closed the connection
the origin did not answer
Request failed
Something went wrong
Sorry
Hmm
Oops
Down for maintenance, we will be back soon
scheduled maintenance in progress
Too many requests from your network. Slow down and retry.
unusual traffic was seen from your device
Please verify you are human
complete the captcha to continue
Checking your browser before accessing this site. Ray
your session has ended
your session has expired
please log in to continue reading
sign in to read the full article
this service is not offered in your area
go back to the start page
open a ticket if this goes on
retry in minutes
please contact the administrator
your browser has JS disabled, so it cannot be shown
You need to enable JavaScript to run this app.
This site requires scripts. Turn them on and reload.
Please turn on scripting support in your settings to view
please enable cookies and JavaScript
Loading...
Quote the reference when you contact support
Quote the reference to the administrator.
Seite nicht gefunden
Zugriff verweigert
Bitte aktivieren Sie JavaScript
"""
