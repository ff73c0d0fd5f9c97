"""Closed vocabularies: grammar sets and label tables."""

from __future__ import annotations

TOKENS = "array<struct<form:string,tag:string,start:int,len:int>>"


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


#: nouns that are too general to be a class
STOP_KO = _set("각 개정 것 경우 결의 관련 기타 내용 다음 등 때 또는 말한다 목 목적 및 바 발생 부분 사유 사항 삭제 수 수수 승계 신설 어느 업무 이익 이하 자 적용 절차 정의 제출 제한 준용 지급 취득 한다 항 해당 행위 호")
STOP_EN = _set("area case example fact form group kind level list member name number order part period place point process range rate result set side state system term thing time type use value way")

FINITE_TAGS, TOPIC_TAGS, FOREIGN_TAGS = _set("EC EF"), _set("JKS JX"), _set("SH SL SN")
SAYS, NAMES = _set("말 일컫"), _set("가리키 불리 칭하")
EXISTS, EXISTS_TAGS = _set("없 있"), _set("VA VV VX")
MUST = _set("아야 어야 여야")
PREFIX_TAGS = _set("SN XPN")
NOT = _set("아니하 않")

GENUS = _set("갈래 분야 일종 종류 품종 하나 한종 형태")
NOT_A_PARENT = _set(
    "가지 갈래 것 결과 경우 곳 기반 기초 나열 낱말 남편 누나 단어 대상 동생 등 딸 때 때문 마련 말 명칭 목록 바 바탕 방법 방식 별칭 부류 부모 부문 부분 부인 분야 뿐 상징 성질 셈 수 수장 아내 아들 아버지 "
    "약칭 어머니 언니 예정 오빠 용어 우두머리 원인 유형 이름 일 일종 자 자식 조상 존재 종류 중 중반 중심 집합 초반 총칭 측면 탓 터 통칭 표기 표현 품종 하나 핵심 형 형태 호칭 후계자 후반 후손"
)
BOUND = _set("다양 대전 론 성 작성 적 정산 조합 주의 화 화학성")

VERBS_FUNCTIONAL = _set("관하 대하 반하 불구하 비하 위하 의하 인하")
VERBS_AUXILIARY = _set("같 되 말 못하 아니하 없 이 있 지 하")
DATIVE = _set("에 에게")

PARTICLES = _set(
    "가 같이 과 까지 께 께서 껜 나 나마 는 는요 는커녕 더러 도 든 든지 라고 라도 랑 로 로서 로써 를 마는 마다 마저 만 만은 만큼 며 밖에 보고 보다 부터 뿐 아 야 야말로 에 에게 에게서 에다 에다가 에서 엔 여 였고 였다 였던 "
    "였으며 였지만 와 요 으로 으로서 으로써 은 은들 은요 은커녕 을 의 이 이거나 이고 이나 이나마 이다 이던 이든 이든지 이라 이라고 이라는 이라도 이란 이랑 이며 이시여 이야 이야말로 이에요 이여 이였고 이였다 이였던 이었고 이었다 이었으며 이자 이지만 "
    "인 인들 입니다 조차 처럼 커녕 하고 한테 한테서"
)
PLURAL = "들"

CALENDAR = _set("기원전 기원후 년 년대 분 세기 시 연도 월 일 초")

NOUNS = _set("NNG NNP")
NOMINAL = _set("NNG NNP SL SN")
NOUNISH = _set("NNB NNG NNP SL SN XR XSN")
CONTENT_NOUNS = _set("NNG NNP SL XR")
RELATIVE_HEADS = _set("가운데 경우 근처 당시 때문 무렵 부근 부분 시절 오늘날 이래 이전 이후 인근 일대 일부 전역")
DEICTIC = _set("당해 이번 해당")

NER_KO = dict(zip("AF AM CV DT EV FD LC MT OG PS PT QT TI TM TR".split(), "인공물 동물 문화·제도 날짜 사건 분야 지역 물질 기관 인물 식물 수량 시간 용어 이론".split()))
NER_EN = {"LOC": "지역", "MISC": "기타", "ORG": "기관", "PER": "인물"}
ENTITY_TYPE = dict(zip("기관 날짜 수량 시간 인물 지역".split(), "ORG DAT NOH DAT PER LOC".split()))
KNOWN_CLASSES = _set("기관 날짜 동물 문화·제도 물질 사건 수량 시간 식물 용어 이론 인공물 인물 지역")
PERSON = "인물"

#: official order of the thirty relation labels; the prefix is the subject's type
_ORG = "dissolved founded place_of_headquarters alternate_names member_of members political/religious_affiliation product founded_by top_members/employees number_of_employees/members"
_PER = "date_of_birth date_of_death place_of_birth place_of_death place_of_residence origin employee_of schools_attended alternate_names parents children siblings spouse other_family colleagues product religion title"
RELATIONS = ["no_relation", *("org:" + n for n in _ORG.split()), *("per:" + n for n in _PER.split())]


def _table(lines: str) -> dict[str, frozenset[str]]:
    out: dict[str, frozenset[str]] = {}
    for line in lines.strip().splitlines():
        names, values = line.split("=")
        for n in names.split():
            out[n] = frozenset(v.replace("_", " ") for v in values.split())
    return out


#: object types that a label may take; the subject's type is that of its prefix
OBJECT_TYPES = _table("""
org:dissolved org:founded per:date_of_birth per:date_of_death = DAT
org:place_of_headquarters per:place_of_birth per:place_of_death per:place_of_residence = LOC ORG POH
org:alternate_names org:political/religious_affiliation org:product per:product per:religion per:schools_attended = ORG POH
org:member_of = LOC ORG POH
org:members = LOC ORG PER POH
org:founded_by = ORG PER
org:top_members/employees per:children per:other_family per:parents per:siblings per:spouse = PER
org:number_of_employees/members = NOH
per:origin = DAT LOC ORG POH
per:colleagues per:employee_of per:title = ORG PER POH
per:alternate_names = PER POH
""")

#: object classes that a label may have where the class is known
OBJECT_CLASSES = _table("""
org:founded_by org:top_members/employees per:children per:colleagues per:other_family per:parents per:siblings per:spouse = 기관 인물
org:dissolved org:founded per:date_of_birth per:date_of_death = 날짜 시간
org:member_of org:members org:place_of_headquarters per:employee_of per:place_of_birth per:place_of_death per:place_of_residence per:schools_attended = 기관 지역
per:origin = 문화·제도 지역
org:number_of_employees/members = 수량
per:title = 문화·제도 용어
""")

#: stems one of which must stand in the sentence
TRIGGERS = _table("""
org:top_members/employees = CEO 교수 근무 기자 대표 부회장 사장 선임 연구원 원장 위원장 이사 일하 임명 장관 재직 총재 취임 합류 회장
per:employee_of = 교수 근무 기자 대표 선임 소속 연구원 원장 위원장 일하 임명 장관 재직 취임 합류 회장
per:title = CEO 교수 기자 대통령 대표 부회장 사장 원장 위원장 의원 이사 장관 총재 회장 후보
org:member_of org:members = 가입 계열 그룹 산하 소속 일원 자회사 편입
org:founded = 개원 만들 발족 설립 세우 세웠 일으 차렸 차리 창립 창업 출범
org:founded_by = 만들 설립 세우 세웠 일으 차렸 차리 창립 창업 출범
org:dissolved = 문닫 문을_닫 청산 파산 폐업 폐지 해산 해체
per:schools_attended = 나오 나왔 다녔 다니 박사 석사 수학 입학 졸업 출신 학사
org:place_of_headquarters = 본사 본점 사옥 소재 위치
per:origin = 국적 출신 태생
per:place_of_birth = 출생 태어
org:product = 개발 생산 서비스 선보 제품 출시 판매
per:children = 딸 아들 자녀 장남 장녀 차남 차녀
per:parents = 딸 모친 부친 아들 아버지 어머니
per:siblings = 누나 동생 언니 자매 형제
per:spouse = 결혼 남편 배우자 부인 아내
""")

RELATIVE_TIME = "(?:올|지난|다음|이번) ?(?:[주달해])|(?:올 ?)?(?:하|상)반기|(?:[1-4] ?)?분기|내일|오늘|어제|당일|최근|이전|이후|당시|이날|오후|오전|내년|작년|지난해|올해|이달|지난|두 ?달.*|.*[달년] ?만|.*개월 ?동안?"

EVIDENCE = {k: v.split() for k, v in {
    "가수": "가수 걸그룹 노래 데뷔곡 멤버 보이그룹 보컬 신곡 아이돌 앨범 음원 컴백",
    "작곡가": "멤버 음악 작곡 프로듀서 히트곡",
    "소설가": "소설 작가 출간",
    "물리학자": "과학자 물리",
    "수학자": "수학",
    "철학자": "사상 철학",
    "화가": "그림 미술 전시 화가",
    "배우": "드라마 배우 연기 영화 조연 주연 출연 캐스팅",
    "시인": "시인 시집",
    "정치인": "당대표 대통령 선거 의원 장관 정치 총리",
    "화학자": "과학자 화학",
    "천문학자": "과학자 천문",
    "역사학자": "사학자 역사가 역사학",
    "경제학자": "경제사상 경제학",
    "언론인": "기자 논설 앵커 언론",
}.items()}

XSD = {n: n for n in "boolean date dateTime decimal double float integer string".split()}
EN_STOP_VERBS = _set("be become do get have make seem take")
