"""Column names and lists that results depend on."""

from __future__ import annotations

# Row key and printed header of the 81 trial-log columns, in file order.
HEADERS = [
    ("id", "序号"),
    ("valid_selection", "有效不等式选择"),
    ("size_signature", "size_signature"),
    ("base_num_vars", "base_num_vars"),
    ("base_num_constrs", "base_num_constrs"),
    ("full_runtime", "full_runtime"),
    ("root_num_constrs", "root_num_constrs"),
    ("runtime", "求解时间"),
    ("legacy_runtime", "legacy_runtime"),
    ("customer_num", "客户数"),
    ("service_num", "服务数"),
    ("product_num", "产品数"),
    ("team_num", "服务团队数"),
    ("scale_phase", "scale_phase"),
    ("scale_stage", "scale_stage"),
    ("opt_trigger", "求解选择"),
    ("random_seed", "random_seed"),
    ("gap", "gap"),
    ("service_time", "服务时间"),
    ("service_price", "服务价格"),
    ("service_cost", "服务成本"),
    ("profit", "利润"),
    ("profit_mean", "利润均值"),
    ("profit_std", "利润标准差"),
    ("profit_high4", "利润上四分位"),
    ("profit_low4", "利润下四分位"),
    ("service_time_lb", "服务时间下界"),
    ("service_price_lb", "服务价格下界"),
    ("service_cost_lb", "服务成本下界"),
    ("service_time_step", "服务时间梯度"),
    ("service_price_step", "服务价格梯度"),
    ("service_cost_step", "服务成本梯度"),
    ("utility", "客户效用值"),
    ("utility_lb", "客户效用值下界"),
    ("utility_step", "客户效用值梯度"),
    ("inventory", "库存"),
    ("inventory_step", "库存梯度"),
    ("inventory_lb", "库存下界"),
    ("Ser_Pro_corr", "产品服务对应关系矩阵"),
    ("Ser_Pro_coe", "产品服务对应关系"),
    ("ser_pro_coe_lb", "产品服务对应关系下界"),
    ("ser_pro_coe_ub", "产品服务对应关系上界"),
    ("Ser_Pro_coe_mean", "产品服务对应关系均值"),
    ("Ser_Pro_coe_std", "产品服务对应关系标准差"),
    ("Ser_Pro_coe_high4", "产品服务对应关系上四分位"),
    ("weight", "客户权重"),
    ("weight_gap", "客户权重gap"),
    ("weight_mean", "客户权重均值"),
    ("weight_std", "客户权重标准差"),
    ("weight_high4", "客户权重上四分位"),
    ("early_start", "服务时间窗Early"),
    ("early_start_lb", "服务时间窗Early下界"),
    ("early_start_ub", "服务时间窗Early上界"),
    ("late_start", "服务时间窗Late"),
    ("late_start_lb", "服务时间窗Late下界"),
    ("late_start_ub", "服务时间窗Late上界"),
    ("early_start_mean", "服务时间窗Early均值"),
    ("late_start_mean", "服务时间窗Late均值"),
    ("early_start_std", "服务时间窗Early标准差"),
    ("late_start_std", "服务时间窗Late标准差"),
    ("early_start_high4", "服务时间窗Early上四分位"),
    ("late_start_high4", "服务时间窗Late上四分位"),
    ("transfer_matrix", "转移时间矩阵"),
    ("transfer_lb", "转移时间矩阵下界"),
    ("transfer_ub", "转移时间矩阵上界"),
    ("transfer_mean", "转移时间矩阵均值"),
    ("transfer_std", "转移时间矩阵标准差"),
    ("transfer_high4", "转移时间矩阵上四分位"),
    ("duration", "工作时长"),
    ("FixedCost", "固定成本"),
    ("VariableCost", "可变成本"),
    ("variable_cost_lb", "可变成本下界"),
    ("variable_cost_ub", "可变成本上界"),
    ("variable_cost_mean", "可变成本均值"),
    ("variable_cost_std", "可变成本标准差"),
    ("variable_cost_high4", "可变成本上四分位"),
    ("cut3_percent", "cut3百分比"),
    ("obj1", "总性价比"),
    ("obj2", "总任务开始时间和"),
    ("obj3", "总利润"),
    ("obj", "函数目标值"),
]

# Printed array columns that get four statistics, with the printed prefix.
STAT_ARRAYS = [
    ("service_time", "服务时间"),
    ("service_price", "服务价格"),
    ("service_cost", "服务成本"),
    ("profit", "利润"),
    ("inventory", "库存"),
    ("weight", "客户权重"),
    ("early_start", "时间窗下界"),
    ("late_start", "时间窗上界"),
    ("utility", "客户效用"),
    ("Ser_Pro_corr", "产品服务对应关系"),
    ("transfer_matrix", "转移时间矩阵"),
    ("VariableCost", "可变成本"),
]

# The four statistics and their printed suffixes.
STATS = [("median", "中位数"), ("mode", "众数"), ("skew", "偏度"), ("kurtosis", "峰度")]

STAT_COLUMNS = [f"{array}_{stat}" for array, _ in STAT_ARRAYS for stat, _ in STATS]

# Columns dropped before modelling.
MODEL_DROP = [
    "id",
    "opt_trigger",
    "random_seed",
    "gap",
    "utility",
    "utility_lb",
    "utility_step",
    "Ser_Pro_corr",
    "Ser_Pro_coe",
    "ser_pro_coe_lb",
    "ser_pro_coe_ub",
    "Ser_Pro_coe_mean",
    "Ser_Pro_coe_std",
    "Ser_Pro_coe_high4",
    "obj1",
    "obj2",
    "obj3",
    "obj",
    "runtime",
    "legacy_runtime",
    "inventory",
    "inventory_step",
    "inventory_lb",
    "weight",
    "profit",
    "service_cost",
    "service_time",
    "service_price",
    "early_start",
    "late_start",
    "transfer_matrix",
    "VariableCost",
    "product_num",
    "service_time_step",
    "service_price_step",
    "service_cost_step",
    "weight_gap",
    "valid_selection",
    "instance_id",
]

# Features left out by the hand-made selections.
SPLIT_SELECTION_DROP = [
    "cut3_percent",
    "early_start_ub",
    "transfer_lb",
    "weight_mode",
    "service_num",
    "service_price_lb",
    "late_start_ub",
    "profit_mode",
    "late_start_lb",
    "early_start_mode",
    "late_start_median",
    "early_start_high4",
    "transfer_mean",
    "FixedCost",
    "weight_median",
    "VariableCost_median",
    "service_cost_lb",
    "inventory_mode",
    "profit_low4",
    "service_price_median",
    "service_cost_median",
    "transfer_matrix_kurtosis",
    "runtime",
    "legacy_runtime",
    "early_start_std",
    "utility_mode",
]
GAIN_SELECTION_DROP: list[str] = []


def header_of(name: str) -> str:
    """Printed header of a log, statistic or bit column; other names stay as they are."""
    return _ALL_HEADERS.get(name, name)


_ALL_HEADERS = dict(HEADERS) | {
    f"{array}_{stat}": prefix + suffix for array, prefix in STAT_ARRAYS for stat, suffix in STATS
} | {f"bundle_bit_{i}": f"Feature{i}" for i in range(1, 7)}
_ALL_KEYS = {header: key for key, header in _ALL_HEADERS.items()}


def key_of(header: str) -> str:
    """Row key of a printed header; other names stay as they are."""
    return _ALL_KEYS.get(header, header)
