"""Word lists and patterns that decide results and so have to be exactly these."""

from __future__ import annotations

# --- acronyms of electronics and computing that need no definition; upper case ------------------
KNOWN_ACRONYMS = (
    "5G",
    "ADC",
    "AES",
    "AI",
    "ASIC",
    "CPU",
    "DAC",
    "DDR",
    "DRAM",
    "DSP",
    "EMC",
    "FPGA",
    "FSM",
    "GPU",
    "HDL",
    "I2C",
    "IOT",
    "JTAG",
    "MCU",
    "OFDM",
    "PCB",
    "PLL",
    "RAM",
    "RF",
    "RFID",
    "ROM",
    "SDRAM",
    "SOC",
    "SRAM",
    "UART",
    "USB",
    "VHDL",
    "VLSI",
    "WIFI",
    "GUI",
    "RTX",
    "NVIDIA",
)

# --- Chinese function words of one character -----------------------------------------------------
FUNCTION_WORDS = ("即", "将", "的", "地", "得", "了", "在", "对", "与", "和", "及", "中", "可", "来", "让", "由", "被", "把", "并", "且", "则")

# --- words in the messages of a review -----------------------------------------------------------
PUNCTUATION_WORDS = ("标点", "句号", "逗号", "分号", "冒号", "顿号", "括号", "引号")
NO_PROBLEM_MESSAGES = ("无明显错误", "没有明显问题", "无明显问题", "无问题", "没有问题")
BARE_CATEGORY_MESSAGES = ("语病导致不通顺", "事实性明显错误", "明显错别字", "错别字", "拼写错误")
STYLE_WORDS = ("格式", "规范", "统一", "一致性", "命名", "大小写", "首字母", "空格", "引用", "引文", "编号", "图表", "表格", "公式编号", "位置不当")
REPLACEMENT_WORDS = ("应改为", "应为", "应写为", "改为")
ISSUE_TYPES = ("语病", "语序不当", "搭配不当", "成分残缺", "句式杂糅", "结构混乱")
WEAK_WORDS = (
    "建议", "可能", "不够清晰", "不明确", "歧义", "更通顺", "更清晰", "更准确", "更正式",
    "建议补充", "建议说明", "建议明确", "建议修改为", "建议改为", "建议将", "可能需要",
)

# --- white space: what JavaScript's trim takes off ----------------------------------------------
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# --- commands of a LaTeX line --------------------------------------------------------------------
HEADING = r"\\(title|chapter|section|subsection|subsubsection)\*?\{(.+)\}"
ENVIRONMENT = r"\\begin\{([a-zA-Z*]+)\}"
ENVIRONMENT_TYPES = {
    "equation": "equation",
    "equation*": "equation",
    "align": "equation",
    "align*": "equation",
    "alignat": "equation",
    "alignat*": "equation",
    "gather": "equation",
    "gather*": "equation",
    "figure": "figure",
    "figure*": "figure",
    "table": "table",
    "table*": "table",
    "titlepage": "environment",
}
