"""What the fields in a title's brackets say: read left to right, each with what came before it.

A bracket may hold brackets of its own (a season behind a name, say); these are fields inside the field. A label tells a
category, a layout mark, a region, genre, broadcaster, credit, disclaimer, section, count, range of episodes, size, year or other
information; what is left is a native or Latin title. Within a field the words run through three states: what stands in front of a
title (stations, years, kinds), the title, and from the first word that ends it (a season, an episode, a section, a date) the rest.
"""

from __future__ import annotations

import re

NATIVE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
LATIN = re.compile(r"[A-Za-z]")
# Words that describe a release and are no titles of it.
KINDS = "movie movies tv series shows animation animations anime documentary documentaries music sports games hd sd uhd pc 电影 電影 剧集 劇集 电视剧 電視劇 纪录片 紀錄片 动漫 動漫 动画 動畫 音乐 音樂 游戏 遊戲 综艺 綜藝 海外综艺 海外綜藝 港综 港綜 连载 連載 完结 完結 合集 分集".split()
LAYOUTS = "tv 连载 連載 完结 完結 完结撒花".split()
INFORMATION = (
    "类型 類型 类别 類別 字幕 导演 導演 主演 演员 演員 语言 音频 音頻 视频 格式 地区 年份 年代 上映 首播 播出 国语 國語 粤语 粵語 英语 英語 日语 日語 韩语 韓語 中字 简繁 簡繁 简中 繁中 简体 簡體 繁体 繁體 双语 雙語 多国 多國 内封 內封 内嵌 內嵌 "
    "杜比 音轨 音軌 花絮 特典 幕后 幕後 原盘 原盤 官方 频道 頻道 高码率 高碼率 码率 碼率 菁彩 源码 源碼 小组录制 小組錄製 出品 评论 評論 台版 港版 日版 美版 英版 加长版 加長版 完整版 导演剪辑 導演剪輯 纪念版 紀念版 菜单 菜單 按钮 按鈕 原生 新增 生肉 自录 自錄 压缩包 壓縮包 破解 自动发种 自動發種 人工编辑 人工編輯 高帧率"
).split()
PEOPLE = "导演 導演 主演 演员 演員".split()
REGIONS = (
    "大陆 大陸 内地 內地 中国大陆 中國大陸 华语 華語 香港 台湾 台灣 美国 美國 英国 英國 日本 韩国 韓國 印度 瑞典 西班牙 意大利 義大利 奥地利 奧地利 墨西哥 法国 法國 德国 德國 加拿大 澳大利亚 澳大利亞 北美 欧洲 歐洲 欧美 歐美 亚洲 亞洲 "
    "东亚 東亞 南亚 南亞 东南亚 東南亞 中东 中東 南美 拉美 非洲 大洋洲 海外"
).split()
DRAMAS = "日剧 日劇 韩剧 韓劇 美剧 美劇 英剧 英劇 港剧 港劇 台剧 台劇 陆剧 陸劇 大陆 大陸 内地 內地".split()
GENRES = (
    "动作 動作 剧情 劇情 犯罪 喜剧 喜劇 爱情 愛情 动画 動畫 动漫 動漫 纪录片 紀錄片 短片 音乐 音樂 家庭 奇幻 恐怖 冒险 冒險 悬疑 懸疑 科幻 历史 歷史 战争 戰爭 古装 古裝 传记 傳記 惊悚 驚悚 情色 同性 儿童 兒童 歌舞 武侠 武俠 西部 灾难 災難 "
    "真人秀 脱口秀 脫口秀 运动 運動 体育 體育"
).split()
BROADCASTERS = ["翡翠台", "明珠台", "中视经典HD", "中視經典HD", "华视HD", "華視HD", "台视HD", "台視HD", "民视HD", "民視HD", "公视HD", "公視HD", "TVB Jade", "TVB Pearl", "TVB Plus", "TVB", "ViuTV", "Jade", "Pearl", "CTV", "CTS", "TTV", "FTV", "PTS"]
STATIONS = "中央电视台 央视 北京卫视 浙江卫视 广东卫视 湖南卫视 江苏卫视 山东卫视 中国广电重温经典频道".split()
CREDITS = "转自 轉自 转载自 轉載自".split()
GROUP_CREDITS = "发布组 發布組 压制组 壓制組 压制部 壓制部".split()
DISCLAIMERS = "如有侵权 如有侵權 联系删除 聯繫刪除 刪除 删除".split()
RECORDINGS = "原创录制 原創錄製".split()
SHORT_DRAMAS = "短剧 短劇".split()
SECTIONS = "正片 纯享 純享 加更 日记 日記 私藏日记 私藏日記 萌娃当家 副本存档中 同学录 同學錄 直播回看 少年的挑战 少年的挑戰 抢先逛 搶先逛 整活局".split()
VARIANTS = "AU AUS US USA UK GB NZ CA NL PT BE".split()
VARIANT_NAMES = "australia canada netherlands portugal belgium".split()
FINALS = "fin fin+sp 合集 完结 完結".split()

# For look-ups: each field of each title asks for these.
KIND_WORDS, REGION_WORDS, GENRE_WORDS, SECTION_WORDS = frozenset(KINDS), frozenset([*REGIONS, *DRAMAS]), frozenset(GENRES), frozenset(SECTIONS)
BROADCASTER_WORDS = frozenset(b.casefold() for b in BROADCASTERS)
FOUR_K, SIZED = re.compile(r"(?i)\s*4K$"), re.compile(r"(\d+(?:[. ]\d+)?)\s*([A-Za-z]+)")
KIND_BREAKS, SEASONED = re.compile(r"[\s/|()（）]+"), re.compile(r"(?i)s\d{1,2}(?:e\d+)?|season\s*\d+")

DIGITS, DASHES = "一二三四五六七八九十两0123456789", "-~至到－—"
SEASON_UNITS, EPISODE_UNITS = "季部", "集话話期"


def numeral(s: str, i: int) -> int:
    """Behind up to four digits, Arabic or Chinese, at i."""
    j = i
    while j < len(s) and s[j] in DIGITS and j - i < 4:
        j += 1
    return j


def blanks(s: str, i: int) -> int:
    while i < len(s) and s[i].isspace():
        i += 1
    return i


def unit_at(s: str, i: int = 0) -> tuple[str, int] | None:
    """(season, episode or count, its end) of what starts at i: 第2季, 第3-5集, 全12集, or the number of a season alone (2季)."""
    whole, ordinal = s.startswith("全", i), s.startswith("第", i)
    j = blanks(s, i + 1) if whole or ordinal else i
    k = numeral(s, j)
    if k == j:
        return None
    n = blanks(s, k)
    if n < len(s) and s[n] in DASHES:
        m = blanks(s, n + 1)
        if (p := numeral(s, m)) > m:
            k, n = p, blanks(s, p)
    if n < len(s) and s[n] in EPISODE_UNITS and (whole or ordinal):
        return ("count" if whole else "episode"), n + 1
    if n < len(s) and s[n] in SEASON_UNITS and (ordinal or s[n] == "季") and not whole:
        return "season", n + 1
    return None


def year_of(s: str) -> int | None:
    return int(s) if len(s) == 4 and s.isascii() and s.isdigit() and s[:2] in ("19", "20") else None


def dated(s: str) -> bool:
    """A day written in eight digits, or a span of two."""
    parts = re.split(f"[{DASHES}]", s)
    return len(parts) <= 2 and all(len(p) == 8 and p.isascii() and p.isdigit() and year_of(p[:4]) and 1 <= int(p[4:6]) <= 12 and 1 <= int(p[6:]) <= 31 for p in parts)


def sized(s: str) -> bool:
    m = SIZED.fullmatch(s)
    return bool(m) and m.group(2).upper() in ("GB", "MB", "TB", "GIB", "MIB", "TIB", "G", "M")


def episodes(s: str) -> tuple[int, int | None] | None:
    """The numbers of a field like 07, 7 (19) or 01-12 fin."""
    i = blanks(s, 0)
    j = numeral(s, i)
    if j == i or not s[i:j].isascii():
        return None
    first, k = int(s[i:j]), blanks(s, j)
    if k == len(s):
        return first, None
    if s[k] == "(" and s.rstrip().endswith(")"):
        inner = s[k + 1 :].rstrip()[:-1].strip()
        return (first, None) if inner.isascii() and inner.isdigit() and len(inner) <= 4 else None
    if s[k] in "-~－—":
        a = blanks(s, k + 1)
        b = numeral(s, a)
        if b > a and s[a:b].isascii() and (s[b:].strip().lower() in ("", *FINALS)):
            return first, int(s[a:b])
    return None


def broadcaster(s: str) -> bool:
    return FOUR_K.sub("", s).casefold() in BROADCASTER_WORDS


def recording(s: str) -> bool:
    bare = s
    for d in DRAMAS[8:12]:
        bare = bare.removeprefix(d)
    return any(bare.startswith(r) for r in RECORDINGS) and (" " not in s or broadcaster(s.split(" ", 1)[1]))


def credited(s: str) -> bool:
    parts = [p.strip() for p in re.split(r"[/|｜]", s) if p.strip()]
    return any(s.startswith(c) and len(s) <= 44 and " " not in s for c in CREDITS) or any(c in s for c in CREDITS) or bool(parts) and all(any(g in p for g in GROUP_CREDITS) and not LATIN.search(p) and len(p) <= 24 for p in parts)


def sections_only(s: str) -> bool:
    return bool(s) and all(w.removesuffix("版") in SECTION_WORDS for w in s.split())


def kinds_only(s: str) -> bool:
    words = KIND_BREAKS.split(s.casefold())
    return any(words) and all(w in KIND_WORDS for w in words if w)


def label(text: str, before: list[str] | None = None) -> str:
    """What a field says; before: the labels of the fields in front of it, if it has its place among them."""
    s = " ".join(text.split())
    if not s:
        return "empty"
    if sized(s):
        return "size"
    if year_of(s):
        return "year"
    if before is not None and before[-1:] == ["category"] and s.casefold() in LAYOUTS:
        return "layout"
    if kinds_only(s):
        return "category"
    if before is not None and before == ["category"] and s in DRAMAS:
        return "drama"
    plain = s.isascii()  # the words of most of what follows are native ones
    if s in REGION_WORDS:
        return "region"
    if not plain and all(w in GENRE_WORDS for w in re.split(r"[\s/]+", s)):
        return "genre"
    if broadcaster(s):
        return "broadcaster"
    if plain:
        return "episodes" if episodes(s) else "season" if SEASONED.fullmatch(s) else "latin" if LATIN.search(s) else "other"
    if recording(s):
        return "recording"
    if any(d in s for d in DISCLAIMERS):
        return "disclaimer"
    if credited(s):
        return "credit"
    if episodes(s):
        return "episodes"
    if sections_only(s):
        return "section"
    unit = unit_at(s)
    if unit and (not s[unit[1] :].strip() or unit_at(s, blanks(s, unit[1])) or year_of(s[unit[1] :].strip())):
        return "count" if unit[0] != "season" else "season"
    if SEASONED.fullmatch(s):
        return "season"
    if any(w in s for w in INFORMATION):
        return "information"
    return "native" if NATIVE.search(s) else "latin" if LATIN.search(s) else "other"


#: Labels of fields that are no titles.
NO_TITLES = ["empty", "size", "year", "category", "layout", "drama", "genre", "broadcaster", "recording", "disclaimer", "credit", "episodes", "section", "count", "season", "information"]


def brackets(raw: str) -> list[tuple[str, list[str]]]:
    """(text, inner fields) of each bracket; what is left open at the end is closed there, a lone closing one means nothing."""
    if "[" not in raw:
        return []
    out, depth, text, inner, nested = [], 0, "", "", []
    for c in [*raw, None]:
        if c == "[" and depth < 2:
            depth += 1
            continue
        if c == "]" or c is None:
            if depth == 2:
                nested.append(inner)
                inner = ""
            elif depth == 1:
                out.append((text, nested))
                text, nested = "", []
            if c is None and depth == 2:
                out.append((text, nested))
            depth = max(0, depth - 1)
            continue
        if depth == 2:
            inner += c
        elif depth == 1:
            text += c
    return out


def numeric_title(s: str) -> bool:
    """Numbers between slashes that are a name, as 11/11/11."""
    parts = s.split("/")
    return len(parts) == 3 and all(p.isascii() and p.isdigit() for p in parts) and max(len(p) for p in parts[:2]) <= 2 and 2 <= len(parts[2]) <= 4


def ends_title(word: str) -> bool:
    """A word behind which nothing of the title comes."""
    bare = word.removesuffix("版")
    return bare in SECTION_WORDS or dated(word) or word.endswith("年度") and year_of(word[:-2]) is not None or unit_at(word) is not None and not word[unit_at(word)[1] :].strip("上中下") or word.startswith("*")


def title_words(field: str) -> str:
    """The title in a field: without stations, years, kinds and broadcasters in front, up to the first word that ends it."""
    s = field
    if not field.isascii():
        s = re.sub(r"【[^】]*】?", " ", field)
        for d in SHORT_DRAMAS:
            s = re.sub(rf"^\s*{d}\s*[:：]", " ", s)
    words, i, native = s.split(), 0, NATIVE.search(s)
    while i < len(words) - 1:
        w = words[i]
        if any(w.startswith(st) for st in STATIONS) or broadcaster(w) or (broadcaster(f"{w} {words[i + 1]}") and i + 2 < len(words)) or (native and year_of(w)) or (native and w in KIND_WORDS and NATIVE.search(w)) or w in RECORDINGS:
            i += 1
            if words[i].upper() == "4K" and i < len(words) - 1:
                i += 1
            continue
        break
    if not native:
        return " ".join(words[i:])
    kept = []
    for w in words[i:]:
        if kept and NATIVE.search(" ".join(kept)) and ends_title(w):
            break
        # A season or an episode may stand at the word's end, as in 山河第二季.
        cut = next((k for k in range(1, len(w)) if w[k] in "第全" and unit_at(w, k)), None) if NATIVE.search(w) else None
        if cut:
            kept.append(w[:cut])
            break
        kept.append(w)
    return " ".join(kept)


def variant_base(s: str) -> str | None:
    """The name in front of a country in parentheses, as in Some Show (AU)."""
    m = re.fullmatch(r"(.+?)\s*\(([^)]{2,24})\)", s.strip())
    return m.group(1) if m and (m.group(2).strip().upper() in VARIANTS or m.group(2).strip().lower() in VARIANT_NAMES) else None


def yearly_base(s: str) -> str | None:
    """The name in front of the year that a native title ends with, as in 歌手2026."""
    return s[:-4].rstrip() if NATIVE.search(s[:-4]) and year_of(s[-4:]) and not s[-5:-4].isdigit() and len(s) > 5 else None
