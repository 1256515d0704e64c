"""Word lists and thresholds. The values are fixed: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

# Categories with priority and keywords, in their order of precedence.
CATEGORIES: dict[str, tuple[int, tuple[str, ...]]] = {
    "AI": (10, ("artificial intelligence", "foundation model", "large language model", "ai model", "machine learning", "ai safety", "neural network", "generative ai", "openai", "llm", "chatbot", "deep learning", "人工智能", "大模型", "机器学习")),
    "航空航天": (9, ("spacecraft", "satellite", "rocket", "aerospace", "aircraft", "aviation", "flight test", "launch", "orbit", "space station", "lunar", "mars", "hypersonic", "航空", "航天", "卫星", "火箭", "高超声速")),
    "军事动态": (10, ("defense ministry", "defense department", "defense technology", "defence", "military", "missile", "radar", "electronic warfare", "procurement", "warship", "fighter jet", "armed forces", "air force", "navy", "army", "pentagon", "nato", "军队", "军事", "导弹", "雷达", "电子战", "军工")),
    "局部冲突": (10, ("ukraine", "russia", "gaza", "israel", "iran", "taiwan", "red sea", "conflict", "attack", "ceasefire", "strike", "escalation", "冲突", "袭击", "停火", "升级", "乌克兰", "加沙")),
    "前沿技术": (8, ("quantum", "fusion", "photonics", "semiconductor", "robotics", "biotechnology", "advanced materials", "superconduct", "chip", "量子", "聚变", "光子", "半导体", "机器人", "生物技术", "先进材料")),
    "无人系统": (10, ("drone", "uav", "uas", "unmanned", "autonomous system", "loitering munition", "counter-uas", "loyal wingman", "collaborative combat aircraft", "cca", "unmanned surface vessel", "musv", "robotic vehicle", "无人机", "无人系统", "自主系统", "巡飞弹", "反无人机")),
}
# Weights of words that tell impact.
IMPACT: dict[str, int] = {"first": 5, "launch": 4, "deploy": 6, "contract": 4, "test": 4, "breakthrough": 6, "production": 5, "export control": 6, "sanction": 5, "ceasefire": 6, "escalation": 7, "attack": 6, "strike": 6, "missile": 5, "nuclear": 7, "quantum": 5, "autonomous": 5, "drone swarm": 6, "首次": 5, "部署": 6, "合同": 4, "试验": 4, "突破": 6, "量产": 5, "停火": 6, "升级": 7, "袭击": 6}
# Words that lower a score, and words that exclude a row.
PENALTY = ("newsletter", "career advice", "crossposted", "podcast", "opinion", "commentary", "book review", "remembered as")
EXCLUDE = ("[sponsored]", "sponsored content", "paid content", "partner content", "advertorial")
# Stop words and aliases of title tokens, further stop words of history tokens.
TITLE_STOPWORDS = ("a", "an", "and", "after", "as", "at", "by", "for", "from", "in", "into", "its", "new", "of", "on", "out", "over", "the", "to", "us", "with", "says", "said")
TITLE_ALIASES = {"sue": "lawsuit", "sued": "lawsuit", "sues": "lawsuit", "suing": "lawsuit", "lawsuits": "lawsuit"}
HISTORY_STOPWORDS = (*TITLE_STOPWORDS, "about", "amid", "could", "latest", "more", "report", "reports", "update", "前沿", "技术", "动态", "消息", "最新", "相关", "表示", "宣布", "报道")
# Marks of a denial.
DENIAL_MARKERS = ("deny", "denies", "denied", "refute", "refutes", "false claim", "dispute", "否认", "驳斥", "不实", "有争议", "未证实")
# Research areas that a category of news draws on, and those that can enable it.
NEWS_RESEARCH_AREAS: dict[str, tuple[str, ...]] = {
    "AI": ("人工智能", "机器学习", "计算机视觉", "机器人与无人系统"),
    "航空航天": ("天文与空间科学", "空间物理", "自主与控制系统"),
    "军事动态": ("自主与控制系统", "机器人与无人系统", "人工智能"),
    "局部冲突": ("机器人与无人系统", "自主与控制系统", "人工智能"),
    "前沿技术": ("量子技术", "先进材料", "空间物理", "机器学习"),
    "无人系统": ("机器人与无人系统", "自主与控制系统", "计算机视觉", "人工智能"),
}
ENABLED_CATEGORIES = ("无人系统", "AI", "军事动态")
ENABLING_AREAS = ("机器人与无人系统", "自主与控制系统", "人工智能", "机器学习")
MISSION_AREAS = ("天文与空间科学", "空间物理")
# Preprint categories with area and priority, in order of precedence; the area and priority of all others.
PAPER_AREAS: tuple[tuple[str, str, int], ...] = (
    ("cs.AI", "人工智能", 10), ("cs.LG", "机器学习", 10), ("cs.RO", "机器人与无人系统", 10), ("cs.CV", "计算机视觉", 8), ("eess.SY", "自主与控制系统", 9),
    ("astro-ph.CO", "天文与空间科学", 8), ("astro-ph.EP", "天文与空间科学", 9), ("astro-ph.GA", "天文与空间科学", 8), ("astro-ph.HE", "天文与空间科学", 9), ("astro-ph.IM", "天文与空间科学", 9), ("astro-ph.SR", "天文与空间科学", 8),
    ("physics.space-ph", "空间物理", 9), ("quant-ph", "量子技术", 8), ("cond-mat.mtrl-sci", "先进材料", 8),
)
OTHER_AREA, OTHER_PRIORITY = "前沿研究", 7
# Collection keywords with priority and aliases.
COLLECTION_KEYWORDS: tuple[tuple[str, int, tuple[str, ...]], ...] = (
    ("多模态智能体", 10, ("multimodal agent", "multimodal agents", "multimodal ai agent", "多模态智能体")),
    ("蜂群机器人", 10, ("swarm robotics", "robot swarm", "uav swarm", "uav swarms", "multi-robot coordination", "蜂群机器人")),
    ("高超声速制导", 10, ("hypersonic guidance", "hypersonic vehicle guidance", "hypersonic control", "高超声速制导")),
)
# Weights of hosts, in order of precedence; weights of feeds by name; weights of other hosts.
HOST_WEIGHTS: tuple[tuple[str, int], ...] = (
    ("reuters.com", 20), ("apnews.com", 19), ("nasa.gov", 20), ("defense.gov", 19), ("darpa.mil", 19), ("nato.int", 18), ("esa.int", 19), ("bbc.com", 17), ("bbc.co.uk", 17), ("aljazeera.com", 16), ("deepmind.google", 18), ("huggingface.co", 16), ("techcrunch.com", 15),
    ("technologyreview.com", 17), ("spectrum.ieee.org", 17), ("ieee.org", 17), ("spacenews.com", 16), ("breakingdefense.com", 16), ("defensenews.com", 16), ("c4isrnet.com", 16), ("defenseone.com", 16), ("flightglobal.com", 15), ("twz.com", 15), ("arstechnica.com", 15), ("theguardian.com", 15),
)
FEED_WEIGHTS: tuple[tuple[str, int], ...] = (
    ("NASA", 20), ("European Space Agency", 19), ("SpaceNews", 16), ("FlightGlobal", 15), ("Breaking Defense", 16), ("Defense News", 16), ("C4ISRNET", 16), ("Defense One", 16), ("DARPA", 19), ("The War Zone", 15), ("BBC World", 17), ("Al Jazeera", 16),
    ("MIT Technology Review", 17), ("IEEE Spectrum", 17), ("Ars Technica", 15), ("TechCrunch AI", 15), ("Google DeepMind", 18), ("Hugging Face", 16),
)
PUBLIC_BODY_WEIGHT, OTHER_WEIGHT = 18, 10
# What is expected of an event (horizon, statement, confidence), linked and not, and what would verify it.
OUTLOOK = (("短期", "关注相关机构的正式文件、时间表变化以及是否出现新的独立来源印证。", "中"), ("中期", "关注该事件是否从单次动态演变为持续的政策、部署、采购或技术验证信号。", "低"))
OUTLOOK_UNLINKED = (("观察", "历史证据不足，暂不作方向性预判；等待新的独立来源或后续正式信息。", "低"),)
FORECAST_SIGNALS: dict[str, tuple[str, str]] = {
    "AI": ("正式模型卡或评测结果", "监管、部署或算力计划变化"),
    "航空航天": ("正式任务时间表或许可", "后续试验、发射或在轨结果"),
    "军事动态": ("正式合同、预算或部署文件", "后续演训、交付或作战序列变化"),
    "局部冲突": ("至少两个独立来源确认", "官方声明、停火执行或兵力态势变化"),
    "前沿技术": ("可复现实验或第三方验证", "工程化、量产或监管节点"),
    "无人系统": ("后续试验与任务数据", "规模化部署、采购或反制变化"),
}
OTHER_SIGNALS = ("新的独立来源", "正式文件或可验证结果")
NO_COUNTRY = "国际"


@dataclass(frozen=True)
class Limits:
    """Windows, caps and thresholds."""

    lookback_hours: int = 24
    future_hours: int = 2
    top_n: int = 10
    candidate_limit: int = 36
    stream_limit: int = 300
    per_category: int = 3
    per_domain: int = 2
    backfill_hours: tuple[int, ...] = (36, 48, 72)
    history_days: int = 365
    history_links: int = 3
    history_min_score: int = 30
    paper_days: int = 7
    paper_limit: int = 60
    paper_per_area: int = 12
    link_limit: int = 3
    link_min_score: int = 24
    retention_days: int = 365
    weekly_limit: int = 8
    baseline_days: int = 30
    min_observed: int = 7
    min_count: int = 2
    min_groups: int = 2
    model_weight: float = 0.65
    timeline: int = 24
    source_groups: int = 16
    news_ids: int = 120
    paper_links: int = 8
    forecasts: int = 12
    evidence_ids: int = 12
    same_story_score: int = 45
    signals: int = 8
    signal_tags: int = 40


LIMITS = Limits()
