"""Words for things that prompts mention."""

from __future__ import annotations

# Names of classes, of things and of grounds.
CLASSES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog",
    "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite",
    "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone",
    "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)
GROUNDS = ("building", "sky", "road", "sidewalk", "tree", "grass", "water", "mountain", "wall", "floor", "ceiling", "ground", "bridge", "fence")
# Korean words, each with its class.
KOREAN = {
    "사람": "person", "사람들": "person", "인물": "person", "남자": "person", "여자": "person", "남성": "person", "여성": "person", "아이": "person", "아기": "person", "학생": "person", "사람이": "person", "모델": "person", "여자분": "person", "남자분": "person", "분들": "person",
    "강아지": "dog", "강쥐": "dog", "멍멍이": "dog", "개": "dog", "댕댕이": "dog",
    "고양이": "cat", "냥이": "cat", "고양이들": "cat",
    "자동차": "car", "승용차": "car", "차량": "car", "차": "car",
    "버스": "bus",
    "트럭": "truck",
    "자전거": "bicycle",
    "오토바이": "motorcycle", "바이크": "motorcycle",
    "새": "bird", "참새": "bird", "비둘기": "bird",
    "말": "horse", "조랑말": "horse",
    "양": "sheep",
    "소": "cow", "젖소": "cow",
    "코끼리": "elephant",
    "곰": "bear",
    "의자": "chair",
    "소파": "couch",
    "침대": "bed",
    "테이블": "dining table", "식탁": "dining table", "탁자": "dining table", "책상": "dining table",
    "병": "bottle", "물병": "bottle",
    "컵": "cup", "머그컵": "cup", "머그잔": "cup", "잔": "cup",
    "노트북": "laptop",
    "휴대폰": "cell phone", "핸드폰": "cell phone", "스마트폰": "cell phone", "폰": "cell phone",
    "가방": "handbag", "핸드백": "handbag",
    "백팩": "backpack", "배낭": "backpack",
    "우산": "umbrella",
    "책": "book",
    "시계": "clock",
    "꽃병": "vase",
    "화분": "potted plant",
    "티비": "tv", "텔레비전": "tv", "모니터": "tv",
    "곰인형": "teddy bear", "인형": "teddy bear",
    "공": "sports ball",
    "스케이트보드": "skateboard",
    "서핑보드": "surfboard",
    "바나나": "banana",
    "피자": "pizza",
    "바다": "water", "호수": "water", "강물": "water", "수면": "water", "냇물": "water",
    "산맥": "mountain", "언덕": "mountain",
    "케이크": "cake",
}
#: Every word with its class. Further words, such as aliases of a deployment, are a parameter of the operators that read prompts.
WORDS = {name: name for name in (*CLASSES, *GROUNDS)} | KOREAN
