"""Configuration of a screening run: plain values handed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Word lists of the action and the strategic dimension.
ACTION_WORDS = (
    "交易", "策略", "买入", "卖出", "配置", "量化", "基金", "仓位", "对冲",
    "杠杆", "期权", "合约", "指标", "模型", "信号", "风险管理",
    "trading", "strategy", "buy", "sell", "portfolio", "allocation", "quant",
    "fund", "position sizing", "hedging", "leverage", "options", "contracts",
    "indicators", "model", "models", "signal", "signals", "risk management",
)
STRATEGIC_WORDS = (
    "宏观", "利率", "通胀", "政策", "监管", "能源", "电力市场", "电网", "储能",
    "光伏", "风电", "碳中和", "碳交易", "AI", "GPU", "数据中心", "基础设施",
    "半导体", "芯片", "竞争格局", "护城河", "商业模式", "壁垒",
    "macro", "interest rate", "inflation", "policy", "regulation", "energy",
    "electricity", "power market", "power grid", "storage", "solar", "wind",
    "carbon", "data center", "data centers", "infrastructure", "semiconductor",
    "semiconductors", "chip", "chips", "competition", "moat", "business model",
)

# Default thresholds and limits of the shipped configuration.
AD_WORDS = (
    "sponsored by", "support for this podcast", "this episode is brought to you by", "advertisement",
    "本期节目由", "感谢赞助", "广告", "赞助商",
)

@dataclass(frozen=True)
class Interests:
    """What a reader looks for; empty lists leave the interest points out."""

    boost: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    people: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    mode: str = "all_preview"
    full_threshold: float = 75
    preview_threshold: float = 45
    min_minutes: int = 5
    short_minutes: int = 15
    weekly_full_limit: int = 5
    weekly_preview_limit: int = 15
    yes_score: float = 75
    yes_transcription: float = 75
    maybe_score: float = 55
    maybe_transcription: float = 55
    ad_words: tuple[str, ...] = AD_WORDS
    action_words: tuple[str, ...] = ACTION_WORDS
    strategic_words: tuple[str, ...] = STRATEGIC_WORDS
    interests: Interests = field(default_factory=Interests)


# The only configuration keys that may be stored with a run.
SAFE_RUN_KEYS = ("enabled", "mode", "agent_id", "model")
