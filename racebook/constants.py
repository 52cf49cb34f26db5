"""Weights, priors, thresholds and labels the results depend on."""

# --- fixed values: model adjustment weights -------------------------------------------
DISPLAY_WEIGHT = 0.32
CURRENT_MEET_WEIGHT = 0.18
COURSE_WEIGHT = 0.16
WEATHER_WEIGHT = 0.10
VENUE_COURSE_WEIGHT = 0.12
CLASS_WEIGHT = 0.12
STRAIGHT_WEIGHT = 0.11
TURN_WEIGHT = 0.11
LAP_WEIGHT = 0.08
ROUGH_WATER_BONUS = 0.06
MIN_VALID = 4

# --- fixed values: racer class scores ---------------------------------------------------
CLASS_SCORE = {"A1": 3, "A2": 2, "B1": 1, "B2": 0}

# --- fixed values: share of second places by winner lane --------------------------------
SECOND_PRIOR = {
    1: {2: 0.3382, 3: 0.2842, 4: 0.1834, 5: 0.1197, 6: 0.0746},
    2: {1: 0.4137, 3: 0.2244, 4: 0.1650, 5: 0.1239, 6: 0.0731},
    3: {1: 0.4082, 2: 0.1907, 4: 0.1852, 5: 0.1302, 6: 0.0857},
    4: {1: 0.3221, 2: 0.1840, 3: 0.1482, 5: 0.2133, 6: 0.1324},
    5: {1: 0.3567, 2: 0.2007, 3: 0.1391, 4: 0.1862, 6: 0.1173},
    6: {1: 0.3484, 2: 0.2029, 3: 0.1551, 4: 0.1766, 5: 0.1169},
}
SECOND_PRIOR_WEIGHT = 0.4

# --- fixed values: share of third places by rank among the remaining lanes --------------
THIRD_PRIOR = {1: 0.3384, 2: 0.2641, 3: 0.2233, 4: 0.1741}
THIRD_PRIOR_WEIGHT = 0.3
GAMMA_SECOND = 0.8
GAMMA_THIRD = 0.65

# --- fixed values: ticket groups and their stake weights --------------------------------
MAIN, COVER, LONGSHOT = "本線", "抑え", "穴"
GROUP_WEIGHT = {MAIN: 1.00, COVER: 0.62, LONGSHOT: 0.30}
GROUP_WEIGHT_VALUE = {MAIN: 1.00, COVER: 0.88, LONGSHOT: 0.78}
GROUP_WEIGHT_OLD = {MAIN: 1.00, COVER: 0.72, LONGSHOT: 0.42}

# --- fixed values: probability bands ------------------------------------------------------
PROB_BANDS = [
    ("0-20%", 0.0, 0.2),
    ("20-40%", 0.2, 0.4),
    ("40-60%", 0.4, 0.6),
    ("60-80%", 0.6, 0.8),
    ("80-100%", 0.8, 1.000001),
]

# --- fixed values: tracking and retention limits ----------------------------------------
MAX_TRACK_MINUTES = 180
RESULT_WAIT_MINUTES = 120
RETENTION_DAYS = 7
SAMPLE_MINUTES = 5
ROW_GAP = 25

# --- fixed values: variant labels of the ablation report ----------------------------------
VARIANTS = ["基礎AI", "＋今節", "＋コース", "＋級別", "＋場特性", "＋展示", "現行全部入り"]

# --- fixed values: reason labels ----------------------------------------------------------
DEFAULT_REASON = "基礎データ中心"

# --- fixed values: venue codes 01..24 -----------------------------------------------------
VENUES = [
    "桐生", "戸田", "江戸川", "平和島", "多摩川", "浜名湖", "蒲郡", "常滑", "津", "三国", "びわこ", "住之江",
    "尼崎", "鳴門", "丸亀", "児島", "宮島", "徳山", "下関", "若松", "芦屋", "福岡", "唐津", "大村",
]

# --- fixed values: reason labels in the order they are listed -----------------------------
REASON = {
    "meet_good": "今節好調",
    "meet_bad": "今節低調",
    "meet_st": "今節ST良好",
    "course_good": "コース適性高",
    "course_bad": "コース適性低",
    "course_st": "コースST良好",
    "class_a1": "級別A1",
    "class_b2": "級別B2(下位)",
    "venue_good": "当水面はイン系有利",
    "venue_bad": "当水面は当該コース不利",
    "rough_bonus": "荒水面でまくり決着多め",
    "flying": "展示F",
    "time_good": "展示タイム上位",
    "time_bad": "展示タイム下位",
    "straight": "直線・伸び足展示上位",
    "turn": "まわり足展示上位",
    "lap": "1周展示上位",
    "rough_outer": "荒水面でアウト不利",
}

# --- fixed values: favourite risk labels ---------------------------------------------------
RISK = {
    "flying": "本命艇が展示F",
    "original_straight": "本命艇の展示直線・伸び足が平均以下",
    "original_turn": "本命艇の展示まわり足が平均以下",
    "exhibition_time": "本命艇の展示タイムが平均以下",
    "motor_2ren": "本命艇のモーターが平均以下",
    "boat_2ren": "本命艇のボートが平均以下",
    "current_meet_top2_rate": "本命艇の今節成績が不振",
}

# --- fixed values: completeness labels -----------------------------------------------------
COMPLETENESS = {
    "racer_win_rate": "全国勝率",
    "local_win_rate": "当地勝率",
    "motor_2ren": "モーター2連率",
    "boat_2ren": "ボート2連率",
    "avg_st": "平均ST",
}

# --- fixed values: comment axes and their weights ----------------------------------------
AXIS_WEIGHTS = {"伸び": 0.27, "出足": 0.27, "回り足": 0.26, "乗り心地": 0.08, "総合気配": 0.12}
GENERAL_AXIS = "総合気配"

# --- fixed values: comment phrases with their scores per axis ------------------------------
PHRASES = {
    "伸び": [
        ("伸びはかなりいい", 1.55), ("伸びがかなりいい", 1.55), ("伸びはいい", 1.05), ("伸びがいい", 1.05),
        ("伸びは良い", 1.05), ("伸びが良い", 1.05), ("伸びる", 0.85), ("直線はいい", 0.95), ("直線がいい", 0.95),
        ("直線は良い", 0.95), ("直線が良い", 0.95), ("伸び寄り", 0.70), ("行き足がいい", 0.80), ("行き足はいい", 0.80),
        ("スリット付近はいい", 0.80), ("下がらない", 0.45), ("伸びがかなり弱い", -1.55), ("伸びはかなり弱い", -1.55),
        ("伸びが弱い", -1.05), ("伸びは弱い", -1.05), ("伸びがない", -1.15), ("直線が弱い", -1.00),
        ("直線は弱い", -1.00), ("伸びられる", -0.85), ("下がる", -0.85), ("スリットから劣勢", -1.00),
    ],
    "出足": [
        ("出足はかなりいい", 1.55), ("出足がかなりいい", 1.55), ("出足はいい", 1.05), ("出足がいい", 1.05),
        ("出足は良い", 1.05), ("出足が良い", 1.05), ("押しがいい", 0.90), ("押している", 0.75),
        ("立ち上がりがいい", 0.85), ("レース足がいい", 0.75), ("出足がかなり弱い", -1.55), ("出足はかなり弱い", -1.55),
        ("出足が弱い", -1.05), ("出足は弱い", -1.05), ("出足がない", -1.15), ("押していない", -0.90), ("押しが弱い", -0.90),
    ],
    "回り足": [
        ("回り足はかなりいい", 1.55), ("回り足がかなりいい", 1.55), ("回り足はいい", 1.05), ("回り足がいい", 1.05),
        ("ターン回りはいい", 1.00), ("ターン回りがいい", 1.00), ("旋回はいい", 0.85), ("回った後がいい", 0.95),
        ("回ってからがいい", 0.95), ("舟の向きがいい", 0.75), ("かかりがいい", 0.80), ("回り足がかなり弱い", -1.55),
        ("回り足はかなり弱い", -1.55), ("回り足が弱い", -1.05), ("回り足は弱い", -1.05), ("ターン回りが弱い", -1.00),
        ("ターン回りは弱い", -1.00), ("回れない", -1.05), ("流れる", -0.90), ("かからない", -0.90), ("舟が向かない", -0.90),
    ],
    "乗り心地": [
        ("乗りやすい", 1.00), ("乗り心地はいい", 1.00), ("乗り心地がいい", 1.00), ("乗り心地は良い", 1.00),
        ("操縦性はいい", 0.90), ("ターンしやすい", 0.85), ("乗りにくい", -1.00), ("乗りづらい", -1.00),
        ("乗り心地が悪い", -1.10), ("操縦性が悪い", -1.00), ("ターンしづらい", -0.90),
    ],
    "総合気配": [
        ("足はかなりいい", 1.45), ("全体的にかなりいい", 1.45), ("足はいい", 0.90), ("足がいい", 0.90),
        ("全体的にいい", 0.90), ("バランスがいい", 0.85), ("上向いた", 0.75), ("良くなった", 0.70), ("手応えがある", 0.75),
        ("納得している", 0.70), ("十分", 0.45), ("悪くない", 0.30), ("普通以上", 0.35), ("まずまず", 0.20),
        ("足はかなり弱い", -1.45), ("全体的にかなり弱い", -1.45), ("足は弱い", -0.95), ("全体的に弱い", -0.95),
        ("良くない", -0.90), ("悪い", -0.85), ("厳しい", -0.95), ("もうひとつ", -0.55), ("合っていない", -0.80),
        ("しっくりこない", -0.70), ("調整が必要", -0.50), ("調整途上", -0.55), ("まだ合っていない", -0.90), ("物足りない", -0.65),
    ],
}
GOOD_WORDS = "いい|良い|上向|手応え|納得"
BAD_WORDS = "悪い|弱い|厳しい|合っていない|物足りない"
UNCERTAIN = [
    "分からない", "わからない", "何とも言えない", "微妙", "調整中", "合わせ切れていない", "まだ調整", "ペラをやる",
    "調整する", "迷っている",
]
VERB_FORMS = [
    ("良かった", "いい"), ("よかった", "いい"), ("良くて", "いい"), ("よくて", "いい"), ("良く", "いい"),
    ("いいですね", "いい"), ("悪かった", "悪い"), ("悪くて", "悪い"), ("やすかった", "やすい"), ("やすくて", "やすい"),
    ("にくかった", "にくい"), ("にくくて", "にくい"), ("づらかった", "づらい"), ("づらくて", "づらい"),
    ("弱かった", "弱い"), ("弱くて", "弱い"), ("強かった", "強い"), ("強くて", "強い"),
]

# --- fixed values: words of a natural comment ----------------------------------------------
COMMENT_LETTERS = "[一-龥々ぁ-んァ-ヶー]"
TABLE_WORDS = [
    "登録番号", "級別", "勝率/2連率", "勝率", "2連率", "通算", "近況", "モーター一覧", "コメント&モーター", "コメント＆モーター",
]
NOISE_WORDS = ["通算", "近況", "パワー", "勝率", "2連率", "登録番号", "級別", "No.", "NO."]
RACE_WORDS = [
    "足", "伸び", "出足", "回り", "まわり", "乗り", "スタート", "ターン", "気配", "エンジン", "モーター", "調整", "ペラ",
    "行き足", "直線", "押し", "舟足", "走り", "水準", "違和感", "手応え", "反応",
]
NATURAL_WORDS = [
    "は", "が", "けど", "けれど", "と思う", "です", "ます", "ない", "いい", "良い", "悪い", "感じ", "欲しい", "している",
    "なった", "ならない", "来なかった", "普通", "十分", "まずまず", "上向き",
]
SCORE_WORDS = [
    "足", "伸び", "出足", "回り", "まわり足", "乗り", "スタート", "ターン", "行き足", "直線", "水準", "違和感", "良く", "悪く",
]

# --- fixed values: shares of the feature parts ----------------------------------------------
MEET_PARTS = (0.45, 0.35, 0.20)
COURSE_PARTS = (0.55, 0.30, 0.15)
FULL_MEET_RACES = 6
ROUGH_WIND, ROUGH_WAVE = 5, 3
WEAK_INSIDE_RATE, STRONG_ATTACK_RATE = 45, 30

# --- fixed values: ticket pools and scores ---------------------------------------------------
MAIN_MIN_RETURN, MAIN_MIN_RANK = 0.90, 0.93
MAIN_SCORE = (0.78, 0.22)
COVER_SCORE = (0.82, 0.18)
COVER_LOW_RETURN, COVER_PENALTY = 0.75, 0.08
LONGSHOT_MIN_RETURN = 1.00
LONGSHOT_SCORE = (0.55, 0.20, 0.25)
LONGSHOT_PENALTY = 0.25
HEDGE_SCORE = (0.5, 0.5)
RETURN_CAP = 2.5

# --- fixed values: stake factors by expected return (upper edge, factor) and probability --------
NO_RETURN_FACTOR = 0.80
CUT_FACTOR, FLOOR_FACTOR = 0.18, 0.45
RETURN_FACTORS = [(1.00, 0.72), (1.30, 1.00), (1.80, 1.10), (2.50, 1.16)]
TOP_RETURN_FACTOR = 1.20
TINY_PROB, SMALL_PROB = 0.001, 0.01
TINY_FACTOR, LOW_FACTOR, SMALL_FACTOR = (0.22, 0.10), (0.42, 0.15), (0.70, 0.10)
WEAK_LONGSHOT_FACTOR = 0.20
PROB_EXPONENT = (0.5, 0.15)
EDGE_CAP, EDGE_GAIN = 1.5, 0.6

# --- fixed values: stake reasons --------------------------------------------------------------
STAKE_REASON = {
    "none": "見送り",
    "tiny": "超低確率のため少額",
    "low": "期待値1未満のため抑制",
    "value": "妙味大きく厚め",
    "main": "本線を厚め",
    "longshot": "穴は上限管理",
    "other": "確率・期待値を加味",
}

# --- fixed values: confidence ------------------------------------------------------------------
CONFIDENCE_SCORE = (0.88, 0.18)
GRADE_A, GRADE_B = 0.33, 0.20

# --- fixed values: patterns and labels of landed pages --------------------------------------------
DAY_LABEL = r"(初日|最終日|\d{1,2}日目)"
CLOSED = "最終R発売終了|本日は非開催|開催終了"
CLOSED_STATUS = "開催終了"
NOT_OPEN = "発売開始前"
NEXT_RACE = r"(\d{1,2})R\s*(\d{1,2}:\d{2})"
CLOCK_TIME = r"(?<!\d)((?:[01]?\d|2[0-3]):[0-5]\d)(?!\d)"
DEADLINE_LABEL = "締切予定時刻"
START_SECTION = ("スタート展示", "水面気象情報")
START_ENTRY = r"(?<!\d)([1-6]\s+F?\s*\.?\s*\d{1,2})(?!\d)"
WEATHER_LABELS = {"temperature": "気温", "wind_speed": "風速", "water_temperature": "水温", "wave_height": "波高"}
COURSE_ENTRY = r"(?:^|\s)([1-6]\s+(?:-{1,2}|\d+(?:\.\d+)?%?))"
TRIFECTA_ENTRY = r"3連単\s*([1-6])\s*[-－]\s*([1-6])\s*[-－]\s*([1-6])"
