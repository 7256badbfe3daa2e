"""Word lists of the audits, in upper case. Fixed values."""

BORDER_WORDS = "DE DA DO DOS DAS E NO NA NOS NAS EM COM A O AO AOS À ÀS QUE SEM".split()
KINSHIP = (
    "MAE MÃE PAI FILHO FILHA IRMAO IRMÃO IRMA IRMÃ ESPOSO ESPOSA PRIMA PRIMO TIO TIA AVO AVÔ AVÓ NETO NETA SOBRINHO SOBRINHA CONJUGE CÔNJUGE "
    "MADRASTA PADRASTO ENTEADO ENTEADA CUNHADO CUNHADA NORA GENRO SOGRO SOGRA COMPANHEIRO COMPANHEIRA GENITORA GENITOR"
).split()
HOSPITAL_ACRONYMS = "HESVV HRAS HEAC HESA HEUE HEC HINSG HSAT HDRAS".split()
TOWN_TRIGGERS = "MUNICIPIO MUNICÍPIO CIDADE RESIDE RESIDENTE NATURAL".split()
STREET_MARKS = "RUA AV AV. AVENIDA BAIRRO Nº N° NO LOGRADOURO TRAVESSA ALAMEDA ESTRADA RODOVIA QUADRA LOTE APTO APT".split()
TITLES = "sr sra dr dra".split()
