"""Golden cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from garimpo.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


CASES = [
    (T.split_glued, "80MMHG", "80 MMHG"),
    (T.split_glued, "enfermagem.RISCOS", "enfermagem. RISCOS"),
    (T.split_glued, "MOMENTO.CONDUTA", "MOMENTO. CONDUTA"),
    (T.split_glued, "GCS15PIFR", "GCS 15 PIFR"),
    *[(T.split_glued, x, x) for x in ("SOPROS.AP", "V.V", "36,5", "37.8", "I10.0", "3.OBS", "COVID19", "__DATA__")],
    *[(T.mask_dates, x, "__DATA__") for x in ("13 / 07 / 22", "17 - 05 - 17", "16 \\ 03 \\ 22", "24.10.2016", "17 DE MAIO DE 2016", "2020-01-02")],
    *[(T.mask_dates, x, x) for x in ("120 - 80 - 70", "1.234.567", "21.9.7390.1882")],
    *[(T.mask_hours, x, "__HORA__") for x in ("07:09:30.123", "07:30 AM", "14:30h", "14h30min45", "9h 30m", "14h30", "9h", "às 10 horas")],
    *[(T.mask_hours, x, x) for x in ("há 3 horas", "120/80", "36.5")],
    *[(T.mask_phones, x, "__TELEFONE__") for x in ("(27) 99999-9999", "(27) 99706.2830", "27 9 9722 3137", "27 33767-7523", "998387639", "33366997")],
    (T.mask_phones, "RG : 998387639", "RG : 998387639"),
    (T.mask_cpf, "123.456.789-00", "__CPF__"),
    (T.mask_cpf, "CPF 12345678900", "CPF __CPF__"),
    (T.mask_ceps, "12345-678", "__CEP__"),
    (T.mask_ceps, "CEP: 12345678", "CEP: __CEP__"),
    (T.mask_emails, "a.b@c.com", "__EMAIL__"),
    (T.drop_controls, "a\tb\u200bc\nd\x00", "a bc\nd"),
    (T.collapse_spaces, " a   b \n  c ", "a b\nc"),
    (T.nfc, "a\u0301", "\u00e1"),
    (T.nfc, None, ""),
    (T.slug, "Experimento 002", "Experimento_002_"),
    (T.slug, None, ""),
    (T.local_float, "0,78", 0.78),
    (T.local_float, "", None),
    (T.text_type, "x [X] y", "template_estruturado"),
    (T.text_type, "livre", "texto_livre"),
    (T.text_type, None, "desconhecido"),
    (T.sentences, "Paciente bem estável. Prescrito repouso no leito. Dr. Fulano viu.", ["Paciente bem estável.", "Prescrito repouso no leito.", "Dr. Fulano viu."]),
    (T.sentences, "SINAIS VITAIS:\nPA: 120x80\nPA: 120x80 mmHg", ["PA: 120x80 mmHg"]),
    (T.sentences, None, []),
    (T.word_tokens, "PA __DATA____HORA__ 36,5 ok.", ["PA", "__DATA__", "__HORA__", "36,5", "ok", "."]),
    (T.word_tokens, None, []),
    (T.blank_tokens, " a  b\nc ", ["a", "b", "c"]),
    (T.is_title, "D'Ávila", True),
    (T.is_upper, "ÀB1", True),
]


@pytest.mark.parametrize("f,given,wanted", CASES)
def test_case(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_masks_together(spark):
    note = "Paciente X, CPF 123.456.789-00, atendido em 01/02/2020 10:30. Tel: (27) 99999-9999.\nCEP 29100-000. Email: a@b.com."
    assert one(spark, note, T.normalize) == "Paciente X, CPF __CPF__, atendido em __DATA__ __HORA__. Tel: __TELEFONE__.\nCEP __CEP__. Email: __EMAIL__."


def test_offsets(spark):
    df = spark.createDataFrame([("ab cd ab", ["ab", "cd", "ab"])], "t string, k array<string>")
    got = df.select(T.token_offsets(F.col("t"), F.col("k"))).first()[0]
    assert [(x["ini"], x["fim"]) for x in got] == [(0, 2), (3, 5), (6, 8)]


@pytest.mark.parametrize(
    ("step", "before", "after"),
    [
        (T.mask_hours, "visto às 10 horas", "visto __HORA__"),
        (T.mask_hours, "visto ÀS 1 hora; há 3 horas", "visto __HORA__; há 3 horas"),
        (T.mask_hours, "às 07:30 e 9h e １２:３０", "às __HORA__ e __HORA__ e __HORA__"),
        (T.mask_ceps, "ENDEREÇO: 29101234, endereco 29101234", "ENDEREÇO: __CEP__, endereco __CEP__"),
        (T.mask_phones, "MÃE 27 - 9.9999 - 1234", "MÃE __TELEFONE__"),
        (T.mask_phones, "CÔNJUGE 27 - 99.999 - 1234; x998387639", "CÔNJUGE __TELEFONE__; x998387639"),
        (T.mask_phones, "RG : 998387639 e (２７) 99999-9999", "RG : 998387639 e __TELEFONE__"),
        (T.mask_dates, "17 de março de 2016 e ação17/05/2017", "__DATA__ e ação17/05/2017"),
        (T.mask_dates, "５/10/2020, 13 / 07 / 22", "__DATA__, __DATA__"),
        (T.mask_cpf, "CPF: 12345678900, é123.456.789-00", "CPF: __CPF__, é123.456.789-00"),
        (T.split_glued, "medicação15ÚLTIMA vez", "medicação 15 ÚLTIMA vez"),
        (T.split_glued, "internação.CONDUTA e não.Está", "internação. CONDUTA e não. Está"),
        (T.split_glued, "ÓBITO.CONDUÇÃO; água,sal", "ÓBITO. CONDUÇÃO; água, sal"),
    ],
)
def test_rules_on_accents_and_wide_digits(spark, step, before, after):
    assert spark.createDataFrame([(before,)], "t string").select(step(F.col("t"))).first()[0] == after
