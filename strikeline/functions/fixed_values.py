"""Published constants and tables that results depend on, stated as they are."""

from __future__ import annotations

# Polynomial of the normal distribution function.
CDF_P = 0.3275911
CDF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Symbol, annual volatility, sector, average daily move in percent, recent high, recent low, beta, rank.
SYMBOL_VOLATILITY = (
    ("AAPL", 0.28, "Technology", 2.1, 0.45, 0.15, 1.24, "medium"),
    ("MSFT", 0.26, "Technology", 1.8, 0.40, 0.18, 0.89, "medium"),
    ("GOOGL", 0.32, "Technology", 2.4, 0.50, 0.20, 1.05, "high"),
    ("AMZN", 0.35, "Technology", 2.8, 0.55, 0.22, 1.33, "high"),
    ("TSLA", 0.65, "Technology", 4.2, 0.85, 0.35, 2.09, "very-high"),
    ("META", 0.42, "Technology", 3.1, 0.65, 0.25, 1.35, "high"),
    ("NVDA", 0.58, "Technology", 3.8, 0.80, 0.30, 1.68, "very-high"),
    ("JNJ", 0.18, "Healthcare", 1.2, 0.28, 0.12, 0.68, "low"),
    ("PFE", 0.22, "Healthcare", 1.5, 0.35, 0.15, 0.71, "medium"),
    ("UNH", 0.20, "Healthcare", 1.4, 0.32, 0.14, 0.75, "low"),
    ("JPM", 0.25, "Financial Services", 1.8, 0.40, 0.16, 1.15, "medium"),
    ("BAC", 0.28, "Financial Services", 2.0, 0.45, 0.18, 1.25, "medium"),
    ("WFC", 0.30, "Financial Services", 2.2, 0.48, 0.20, 1.31, "high"),
    ("KO", 0.16, "Consumer Defensive", 1.0, 0.25, 0.10, 0.62, "low"),
    ("PG", 0.15, "Consumer Defensive", 0.9, 0.24, 0.09, 0.55, "low"),
    ("WMT", 0.19, "Consumer Defensive", 1.3, 0.30, 0.12, 0.51, "low"),
    ("XOM", 0.32, "Energy", 2.3, 0.50, 0.20, 1.42, "high"),
    ("CVX", 0.28, "Energy", 2.0, 0.45, 0.18, 1.28, "medium"),
    ("NEE", 0.14, "Utilities", 0.8, 0.22, 0.08, 0.45, "low"),
    ("DUK", 0.16, "Utilities", 1.0, 0.25, 0.10, 0.52, "low"),
    ("ORCL", 0.24, "Technology", 1.7, 0.38, 0.16, 0.95, "medium"),
)

# Sector, annual volatility, average daily move in percent, lowest and highest implied volatility, beta, rank.
SECTOR_VOLATILITY = (
    ("Technology", 0.35, 2.5, 0.25, 0.60, 1.2, "high"),
    ("Healthcare", 0.22, 1.5, 0.18, 0.35, 0.7, "low"),
    ("Financial Services", 0.28, 2.0, 0.20, 0.45, 1.2, "medium"),
    ("Consumer Cyclical", 0.25, 1.8, 0.20, 0.40, 1.1, "medium"),
    ("Consumer Defensive", 0.18, 1.2, 0.12, 0.28, 0.6, "low"),
    ("Communication Services", 0.30, 2.2, 0.22, 0.50, 1.1, "high"),
    ("Industrials", 0.24, 1.7, 0.18, 0.35, 1.0, "medium"),
    ("Energy", 0.32, 2.3, 0.25, 0.50, 1.3, "high"),
    ("Utilities", 0.16, 1.0, 0.12, 0.25, 0.5, "low"),
    ("Real Estate", 0.26, 1.9, 0.18, 0.38, 0.9, "medium"),
    ("Materials", 0.28, 2.1, 0.20, 0.42, 1.1, "medium"),
)

# Multiplier of the daily move by volatility rank.
RANK_MULTIPLIER = {"low": 0.85, "medium": 1.0, "high": 1.15, "very-high": 1.3}

# Lowest percentile, level, colour, recommendation, description ({n} is the number of days).
IV_LEVELS = (
    (90, "extremely-high", "red", "strong-sell", "IV is in the top 10% of the {n}-day range. Options are very expensive."),
    (75, "high", "orange", "sell", "IV is in the top 25% of the {n}-day range. Options are expensive."),
    (60, "above-average", "yellow", "neutral", "IV is above average for the {n}-day period. Options are moderately expensive."),
    (40, "average", "green", "neutral", "IV is near the average for the {n}-day period. Options are fairly priced."),
    (25, "below-average", "blue", "neutral", "IV is below average for the {n}-day period. Options are moderately cheap."),
    (10, "low", "blue", "buy", "IV is in the bottom 25% of the {n}-day range. Options are cheap."),
    (None, "extremely-low", "purple", "strong-buy", "IV is in the bottom 10% of the {n}-day range. Options are very cheap."),
)

# Factors from a straddle's move to a day, a week and a month, by method.
HORIZON_FACTORS = {"divide": (1 / 30, 1 / 4, 1.0), "scale": (1.0, 2.65, 5.48)}
