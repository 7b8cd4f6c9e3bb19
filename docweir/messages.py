"""User-facing texts emitted as data.

Fixed values: these strings are part of the results and must read exactly so.
"""

UNVERIFIED_REPAIR = "Nazorat raqami mos kelmadi — hujjatdagi qiymat bilan solishtiring"
AMBIGUOUS_FIELD = ("MRZ maydoni '", "' uchun bir nechta variant mos keldi (",
                   ") - qo'lda tekshiring")
PINFL_SEX = "JSHSHIR dagi jins MRZ dagi jinsga mos kelmadi"
PINFL_BIRTH = "JSHSHIR dagi tug'ilgan sana MRZ dagiga mos kelmadi"
COMPOSITE_FAILED = "MRZ umumiy nazorat raqami mos kelmadi — hujjatni qayta suratga oling"
REPAIRED = "MRZ tuzatildi: "

BIRTH_BEFORE_1900 = "Tug'ilgan sana 1900-yildan oldin — o'qishda xato bo'lishi mumkin"
BIRTH_IN_FUTURE = "Tug'ilgan sana kelajakda"
ISSUED_BEFORE_BIRTH = "Hujjat berilgan sana tug'ilgan sanadan oldin"
EXPIRY_BEFORE_ISSUE = "Amal qilish muddati berilgan sanadan oldin yoki teng"
EXPIRED = "Hujjat muddati tugagan"

ZONES_DIFFER = "MRZ va vizual zona mos kelmadi ("
NOT_ON_FACE = ("MRZ dagi '", "' qiymati hujjat yuzida topilmadi — hujjatni diqqat bilan tekshiring")
REJECTED = ("' qiymati rad etildi (", ") - model tasdiqlanmagan ma'lumot qaytardi")

QUALITY = {
    "blur": "Rasm juda xira — hujjatni tekis qo'yib, yorug'roq joyda qayta suratga oling",
    "dark": "Rasm juda qorong'i — yorug'roq joyda suratga oling",
    "bright": "Rasm juda yorqin — to'g'ridan-to'g'ri yorug'likdan chetlanib suratga oling",
    "contrast": "Rasm kontrasti past — fon bilan hujjat ajralmayapti",
    "glare": "Hujjat ustida yorqin dog' bor — matnni yopib qo'yishi mumkin, boshqa burchakdan suratga oling",
    "dpi": "Rasm o'lchami kichik — hujjatni kadrga to'liq sig'diring va yaqinroqdan oling",
    "moire": "Ekrandan olingan surat aniqlandi — asl hujjatni suratga oling",
}
UNKNOWN_TYPE = "Hujjat turi aniqlanmadi. Pasport, ID karta yoki diplom suratini yuklang."
REFUSED_BY_POLICY = ("Demo rejimida haqiqiy hujjat qabul qilinmaydi. Mashina o'qiydigan zona (MRZ) lokal o'qildi, lekin qolgan "
                     "maydonlarni tahlil qilish uchun pullik rejim kerak.")
LOCAL_ONLY = "Qo'shimcha tahlil qatlami mavjud emas — natija faqat lokal o'qish asosida"
MISSING_REQUIRED = " ta majburiy maydon bo'sh qoldi — hujjatni yuborishdan oldin to'ldiring"
EMPTY_FILE = "Fayl bo'sh"
UNKNOWN_FILE = "Fayl turi aniqlanmadi. JPEG, PNG, WebP yoki PDF yuklang"
UNSUPPORTED_FILE = "Qo'llab-quvvatlanmaydigan fayl turi: "
TOO_LARGE = "Fayl juda katta"
