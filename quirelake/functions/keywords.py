"""Fixed values that decide what documents and tables are.

These must equal the values that users of such documents rely on; they are data,
kept in natural order, and passed as parameters everywhere.
"""

from __future__ import annotations

# --- fixed values: document kinds -------------------------------------------------
ESTIMATE = ("견적", "견적서", "견적금액", "내역서", "납품기일", "결제조건", "견적유효기간", "직접비", "간접비", "품목", "수량", "단가", "공급가액")
PUMSEM = ("품셈", "수량산출", "부문", "공종", "단위", "적용기준", "노무비", "참조", "보완")
BOM = ("BILL OF MATERIALS", "BILL OF MATERIAL", "S/N", "MARK", "WT(KG)", "Q'TY", "MAT'L", "LINE LIST", "LINE NO", "DESCRIPTION", "DWG NO", "UNIT", "WEIGHT", "LOSS")
BOM_STRUCTURE = ("S/N", "MARK", "WT(KG)", "Q'TY", "MAT'L", "DESCRIPTION", "DWG NO", "UNIT", "WEIGHT")
MATERIAL_QUOTE = ("견적서", "건명", "결정금액", "거래처", "공급가액", "항목", "품목", "사양", "치수", "수량", "단가", "중량", "메모")
MATERIAL_QUOTE_HEADER = (("항목", "치수", "수량", "단가", "공급가액"), ("품목", "치수", "수량", "단가", "공급가액"))
MATERIAL_QUOTE_HITS = 5

# --- fixed values: tables of a bill of materials ----------------------------------
BOM_HEADER_GROUPS = (("S/N", "SN", "MARK", "NO", "NO."), ("SIZE", "SPEC", "SPECIFICATION"), ("Q'TY", "QTY", "QUANTITY", "WT", "WEIGHT", "WT(KG)"))
LINE_HEADER_GROUPS = (("LINE NO", "LINE NO."), ("SN", "S/N"), ("ITEM", "REMARKS"))
BOM_ANCHORS = ("BILL OF MATERIALS", "BILL OF MATERIAL")
LINE_ANCHORS = ("LINE LIST",)
BOM_BLACKLIST = ("CLIENT:", "CLIENT：", "CONTRACTOR:", "CONTRACTOR：", "PROJECT:", "PROJECT：", "TITLE:", "TITLE：", "DRAWING NO", "SCALE", "SUPPORT DWG", "DWG LIST")
BOM_KILL = ("TOTAL WEIGHT", "TOTAL:", "CLIENT:", "CLIENT：", "CONTRACTOR:", "CONTRACTOR：", "PROJECT:", "PROJECT：", "TITLE:", "TITLE：", "DRAWING NO", "SCALE", "DESCRIPTION")
NOISE_ROW = ("DRW'D", "CHK'D", "APP'D", "DETAIL DRAWINGS", "PIPE SUPPORT", "SUPPORT DWG", "DWG LIST")
REV_MARKERS = ("REV", "DATE", "DESCRIPTION", "DRW'D")
SUB_HEADERS = ("NO", "ITEM", "DESCRIPTION", "SPEC", "SIZE", "DWG", "REMARK", "MAT'L", "MATERIAL", "UNIT", "WEIGHT", "LOSS", "M2", "KG", "QTY", "Q'TY", "단위", "수량", "중량", "면적")
UNIT_VALUE = r"^(?i:EA|SET|LOT|M|M2|M3|KG|TON|식|개|대|본|매|조|개소)$"
BOM_ALIASES = {
    "SIZE": ("SIZE",),
    "MATERIAL": ("MATERIAL", "MAT'L", "MATL", "재질"),
    "QUANTITY": ("Q'TY", "QTY", "수량"),
    "WEIGHT": ("WT(KG)", "WT", "WEIGHT", "중량"),
    "DESCRIPTION": ("DESCRIPTION", "DESC", "품명"),
    "ITEM_NO": ("ITEM NO.", "ITEM", "NO", "ITEM NO"),
}

# --- fixed values: table contract -------------------------------------------------
BOM_MATERIAL_WORDS = ("DESCRIPTION", "DWGNO", "MATL", "SIZE", "수량", "단위", "자재중량", "자재면적")
MATERIAL_QUANTITY_WORDS = ("설치구분", "제품", "철판종류", "치수", "재질", "개별제품중량", "전체중량", "전체단면적", "도장면적")
ESTIMATE_ITEM_WORDS = ("NO", "품목", "항목", "재질", "치수", "수량", "중량", "단가", "단위", "공급가액", "금액", "메모")
ESTIMATE_WORDS = ("명칭", "품명", "규격", "단위", "수량", "단가", "금액")
TRADE_WORDS = ("거래명세표", "공급자보관용", "공급받는자", "사업자등록번호")
SOURCE_INFO_WORDS = ("상호", "등록번호", "주소", "업태", "전화번호", "입금계좌", "FAX", "사업자등록번호")
CONDITION_LABELS = {"납기": "납기", "남기": "납기", "운송조건": "운송조건", "운습조건": "운송조건", "결제조건": "결제조건", "착지": "착지", "인도조건": "인도조건"}
DETAIL_COLUMNS = ("품명", "규격", "단위", "수량", "재료비_단가", "재료비_금액", "노무비_단가", "노무비_금액", "경비_단가", "경비_금액", "합계_단가", "합계_금액", "비고")
LABOUR_ROWS = ("인부", "철공", "용접공", "배관공", "기사", "기능공", "기능사", "조공", "내장공", "도장공", "미장공", "목공", "방수공", "보통인부", "특별인부", "잡역부")
TYPE_HEADERS = {"A_품셈": ("수량", "단위", "인", "대", "수 량", "단 위"), "B_규모기준": ("억", "m²", "규모", "직접노무비"), "C_구분설명": ("구분", "내용", "구 분", "내 용")}

# --- fixed values: corrections and patterns ---------------------------------------
OCR_CORRECTIONS = (
    ("HD현대오일백크", "HD현대오일뱅크"),
    ("오일백크", "오일뱅크"),
    ("건적금액", "견적금액"),
    ("건적일", "견적일"),
    ("건적", "견적"),
    ("결적유효기간", "견적유효기간"),
    ("결적 담당자", "견적 담당자"),
    ("결적 외", "견적 외"),
    ("결적", "견적"),
    ("신급금", "선급금"),
    ("충합계", "총합계"),
    ("적절비", "직접비"),
    ("물랑 산초丑", "물량 산출표"),
)
SECRETS = ((r"((?:api_key|API_KEY|GEMINI_API_KEY|ZAI_API_KEY|MISTRAL_API_KEY)[\"']?\s*[:=]\s*[\"']?)[^\"'\s]{8,}", "$1***MASKED***"),)
MIN_VISIBLE_CHARS, MIN_VISIBLE_PER_PAGE, MIN_STRUCTURED_CHARS = 200, 80, 400
TABLE_SCORE, BLOCK_SCORE = 600, 250
