"""What receipts print: names, labels and words, and the patterns built from them."""

from __future__ import annotations

import re

from .spans import starting

# Banks, as key | name | BIC | other names | tier | parent. In the order of the registry.
REGISTRY_TEXT = """
maybank | Maybank | MBBEMYKL | MAYBANK2U, M2U, M2E, MAYBANK2E, MBB, MYB, MALAYAN BANKING, MAYBANK2U BIZ, M2U BIZ, MAYBANK2E-ADMIN | retail |
cimb | CIMB | CIBBMYKL | CIMB BANK, CIMB CLICKS, CIMBCLICKS, BIZCHANNEL, BIZCHANNEL@CIMB, MYBUSINESSCARE, OCTO | retail |
public_bank | Public Bank | PBBEMYKL | PBEBANK, PBE BANK, PBB, PB ENTERPRISE, PBENTERPRISE | retail |
rhb | RHB | RHBBMYKL | RHB BANK, RHBNOW, RHB NOW, REFLEX, RHBGROUP, RHBCAMS | retail |
hong_leong | Hong Leong Bank | HLBBMYKL | HONG LEONG, HONGLEONG, HLB, HL BANK, HLBCONNECT, CONNECTFIRST, CONNECT FIRST | retail |
ambank | AmBank | ARBKMYKL | AMONLINE, AM BANK, AMACCESS, AMBANK GROUP | retail |
alliance | Alliance Bank | MFBBMYKL | ALLIANCE, ALLIANCEONLINE, BIZSMART, ALLIANCEBIZSMART | retail |
affin | Affin Bank | PHBMMYKL | AFFIN, AFFINONLINE, AFFINALWAYS | retail |
bank_islam | Bank Islam | BIMBMYKL | BIMB, GO BY BANK ISLAM | retail |
bank_muamalat | Bank Muamalat | BMMBMYKL | MUAMALAT, IMUAMALAT | retail |
bank_rakyat | Bank Rakyat | BKRMMYKL | BANK KERJASAMA RAKYAT, IRAKYAT | retail |
bsn | BSN | BSNAMYK1 | BANK SIMPANAN NASIONAL, MYBSN | retail |
agrobank | Agrobank | AGOBMYKL | BANK PERTANIAN, AGRONET | retail |
al_rajhi | Al Rajhi Bank | ARAJMYKL | AL RAJHI, ALRAJHI, AL-RAJHI | retail |
mbsb | MBSB Bank | AFBQMYKL | MBSB, ASIAN FINANCE | retail |
kfh | Kuwait Finance House | KFHOMYKL | KFH | retail |
hsbc | HSBC | HBMBMYKL | HSBC BANK, HSBC MALAYSIA | retail |
standard_chartered | Standard Chartered | SCBLMYKX | STANCHART, SCB, SC MALAYSIA, STRAIGHT2BANK | retail |
ocbc | OCBC | OCBCMYKL | OCBC BANK, VELOCITY, OCBC VELOCITY | retail |
uob | UOB | UOVBMYKL | UNITED OVERSEAS BANK, UOB MALAYSIA, BIBPLUS, #HUOB, HUOB, HHUOB, IIIIUOB, IIUOB, ||||UOB | retail |
citibank | Citibank | CITIMYKL | CITI, CITIDIRECT | retail |
bnp_paribas | BNP Paribas | BNPAMYKL | BNPP | retail |
maybank_islamic | Maybank Islamic | MBISMYKL | | islamic | maybank
cimb_islamic | CIMB Islamic | CTBBMYKL | | islamic | cimb
public_islamic | Public Islamic Bank | PIBEMYKL | PUBLIC ISLAMIC | islamic | public_bank
rhb_islamic | RHB Islamic Bank | RHBAMYKL | RHB ISLAMIC | islamic | rhb
hong_leong_islamic | Hong Leong Islamic Bank | HLIBMYKL | HONG LEONG ISLAMIC, HLISB | islamic | hong_leong
ambank_islamic | AmBank Islamic | AISLMYKL | AMISLAMIC | islamic | ambank
alliance_islamic | Alliance Islamic Bank | ALSRMYKL | ALLIANCE ISLAMIC | islamic | alliance
affin_islamic | Affin Islamic Bank | AIBBMYKL | AFFIN ISLAMIC | islamic | affin
hsbc_amanah | HSBC Amanah | HMABMYKL | AMANAH | islamic | hsbc
scb_saadiq | Standard Chartered Saadiq | | SAADIQ | islamic | standard_chartered
ocbc_alamin | OCBC Al-Amin | OABBMYKL | AL-AMIN, AL AMIN | islamic | ocbc
gxbank | GXBank | | GX BANK, GXS | digital |
aeon_bank | AEON Bank | | | digital |
boost_bank | Boost Bank | | | digital |
kaf_digital | KAF Digital Bank | | KAF DIGITAL, KAF BANK | digital |
ryt_bank | Ryt Bank | | | digital |
bank_of_china | Bank of China (Malaysia) | BKCHMYKL | BANK OF CHINA | foreign |
icbc | ICBC (Malaysia) | ICBKMYKL | ICBC, INDUSTRIAL AND COMMERCIAL BANK OF CHINA | foreign |
ccb | China Construction Bank (Malaysia) | PCBCMYKL | CHINA CONSTRUCTION BANK, CCB | foreign |
mufg | MUFG Bank (Malaysia) | BOTKMYKX | MUFG, BANK OF TOKYO, MITSUBISHI UFJ, GCMS PLUS, GCMS, COMSUITE | foreign |
smbc | Sumitomo Mitsui (Malaysia) | SMBCMYKL | SUMITOMO MITSUI, SMBC | foreign |
mizuho | Mizuho Bank (Malaysia) | MHCBMYKA | MIZUHO | foreign |
deutsche | Deutsche Bank (Malaysia) | DEUTMYKL | DEUTSCHE BANK | foreign |
jpmorgan | J.P. Morgan (Malaysia) | CHASMYKX | J.P. MORGAN, JP MORGAN, JPMORGAN, CHASE | foreign |
bangkok_bank | Bangkok Bank (Malaysia) | BKKBMYKL | BANGKOK BANK | foreign |
coopbank_pertama | Co-opbank Pertama | | COOPBANK PERTAMA, KOPERASI BANK PERSATUAN | development |
bank_pembangunan | Bank Pembangunan Malaysia | BPMBMYKL | BANK PEMBANGUNAN, BPMB | development |
exim_bank | EXIM Bank Malaysia | EXMBMYKL | EXIM BANK, EXPORT-IMPORT BANK OF MALAYSIA | development |
duitnow | DuitNow | | DUIT NOW | rail |
jompay | JomPAY | | JOM PAY | rail |
fpx | FPX | | FINANCIAL PROCESS EXCHANGE | rail |
rentas | RENTAS | | | rail |
ibg | IBG | | INTERBANK GIRO | rail |
tng | Touch n Go | | TOUCH 'N GO, TNG EWALLET, TNGD | rail |
grabpay | GrabPay | | GRAB PAY | rail |
boost_ewallet | Boost eWallet | | | rail |
shopeepay | ShopeePay | | SHOPEE PAY | rail |
"""
# Names of portals and products: they are printed only by the bank that issued the receipt.
PORTALS = "MAYBANK2U, M2U, M2E, MAYBANK2E, MAYBANK2E-ADMIN, MAYBANK2U BIZ, M2U BIZ, CIMB CLICKS, CIMBCLICKS, BIZCHANNEL, BIZCHANNEL@CIMB, MYBUSINESSCARE, OCTO, PBEBANK, PBE BANK, PB ENTERPRISE, PBENTERPRISE, RHBNOW, RHB NOW, REFLEX, RHBGROUP, RHBCAMS, HLBCONNECT, CONNECTFIRST, CONNECT FIRST, AMONLINE, AMACCESS, AMBANK GROUP, ALLIANCEONLINE, BIZSMART, ALLIANCEBIZSMART, AFFINONLINE, AFFINALWAYS, GO BY BANK ISLAM, IMUAMALAT, IRAKYAT, MYBSN, AGRONET, VELOCITY, OCBC VELOCITY, BIBPLUS, CITIDIRECT, STRAIGHT2BANK, GCMS PLUS, GCMS, COMSUITE".split(", ")
MONTH_FIRST = ["citibank"]
# What OCR makes of bank names, and the names.
OCR_BANKS = {"H5BC": "HSBC", "H58C": "HSBC", "MAYBONK": "MAYBANK", "MAYB0NK": "MAYBANK", "C1MB": "CIMB", "CIM8": "CIMB", "C1M8": "CIMB", "R4B": "RHB", "RH8": "RHB", "U0B": "UOB", "0CBC": "OCBC"}
# Marks of interbank transfers.
INTERBANK = ["IBG", "INTERBANK", "INTER-BANK", "INTER BANK", "GIRO", "OUTWARD ACH", "INWARD ACH", "ACH TRANSFER", "DUITNOW", "INSTANT TRANSFER", "FUNDS TRANSFER", "RENTAS"]
# Labels of references, by who gives them: the name that is reported, then other spellings.
REFERENCE_LABELS = {
    "payer_supplied": [["Recipient Reference"], ["Recipient Ref./Customer Ref. No."], ["Customer Ref"], ["Your Reference No"], ["End to End ID"], ["2nd party reference"], ["Other Payment Details", "Other Payment Details/Advice", "Other Payment Detail"], ["Other Details", "Other Detail"], ["Payment Details", "Payment Detail"], ["Debit Reference"], ["Debit Description"], ["Remark"]],
    "bank_secondary": [["Service Reference No"], ["PayNet Reference No"], ["DuitNow Reference No"], ["Channel Reference No"], ["Batch Reference"], ["Import Reference"], ["Back Office Reference"], ["Instruction reference"], ["UTR Reference"], ["UETR", "Tracking Number (UETR)", "UETR Number"], ["RPP Business Message ID"], ["RPP Simplified ID"], ["RPP Reference Number"], ["Entry No."]],
    "bank_primary": [["Bank Payment Reference"], ["Transaction Reference No"], ["Advice Reference no"], ["OCBC Reference No"], ["iGTB Reference"], ["Txn Ref No"], ["SCB Ref"], ["Group No."], ["MUFG Reference"], ["Payment Reference"], ["Bank Reference"], ["Reference No"]],
}
# Names that are labels only with a Number, No. or ID after them.
NEED_NUMBER = ["Entry No.", "Group No.", "Txn Ref No", "Reference No"]
# Confidence of a primary reference by its label in thousandths; others of the role, and other roles.
PRIMARY_CONFIDENCE = {"Transaction Reference No": 990, "Txn Ref No": 990, "Bank Payment Reference": 980, "OCBC Reference No": 980, "iGTB Reference": 970, "Advice Reference no": 970, "SCB Ref": 970, "Group No.": 960, "Bank Reference": 960, "Reference No": 950}
ROLE_CONFIDENCE = {"bank_primary": 950, "bank_secondary": 900, "payer_supplied": 850}
# Primary labels that give way to any other primary one.
GIVE_WAY = ["Bank Reference", "iGTB Reference"]
# Labels of other fields, which are never values and take up places in blocks of values.
OTHER_LABELS = "Product Type, Approval Status, Transaction Status, Transaction Status Reason, Transfer Type, Transfer Mode, Payment Type, Payment Date, Payment Mode, Value Date, From Account, To Account, Account No, Account No., Account Number, Account Name, Beneficiary, Beneficiary Bank, Beneficiary Name, Beneficiary Account No, Beneficiary Account No., Recipient Bank, Payee, Payee Name, Payee Bank, Amount, Amount (MYR), Fee, SMS Fee, Total Charges, Total Amount, Total Fee, Total Debit Amount, Service Charge, Service Charges, Status, Currency, Transaction Date, Transaction Date, Time, Date and Time, Channel, Recipient's DuitNow ID, Recipient's DuitNow ID Type, Debit Account, Credit Account, Charges Borne By, Category, Purpose, Purpose Of Transfer, Purpose Code, Applicant, Applicant ID, Applicant Address, Applicant Details, Reason, User, User Activities, Activities, Advice Detail, Advice Date, Instruction to Bank, Instruction Mode, Send Payment Advice, Business Reg. No., Zip/Postal Code, State/Province, Prefecture, City/District, Country, Remarks, Source Of Fund, Ultimate Debtor Name, Ultimate Creditor Name, Beneficiary Citizenship, Beneficiary Category, Beneficiary Bank Branch, Payee/Beneficiary Details, Transaction Type, Resident, Maker, Favourite Name, Fund Transfer Purpose".replace("Transaction Date, Time", "Transaction Date; Time").split(", ")
# What stands in the place of a value without being one.
NO_VALUES = "SUCCESSFUL, SUCCESS, PROCESSED, PENDING, FAILED, COMPLETED, APPROVED, RESIDENT, YES, NO, NONE, NIL, MYR, RM, FUND TRANSFER, FUNDS TRANSFER, CURRENT ACCOUNT, ACCOUNT NUMBER, INTERNET PORTAL, NEW TRANSFER, DUITNOW TRANSFER, OUTWARD ACH, INTERBANK GIRO IBG, INTERBANK GIRO, DUITNOW, GIRO, IBG, DUITNOW PAYMENT, INSTANT TRANSFER, INWARD ACH, IMMEDIATE TRANSFER, POST DATED TRANSFER, FAVOURITE ACCOUNT TRANSFER, THIRD PARTY TRANSFER, ACH CREDIT GIRO, PAYLINK GIRO, AUTOMATED CLEARING HOUSE ACH, ACCOUNT NO DUITNOW ID, PAYMENT METHOD, PAYMENT TYPE, PAYMENT DETAILS, SEARCH CRITERIA, STATUS SUCCESS, STATUS SUCCESSFUL, STATUS PROCESSED, DATE TIME, TRANSFER TYPE, TRANSFER MODE, PRODUCT TYPE, TRANSACTION DETAILS, BENEFICIARY DETAILS, PAYER DETAILS, ADDITIONAL INFORMATION, INSTRUCTION MODE, APPROVAL STATUS".split(", ")
# Labels of money by family.
TOTAL_DEBIT = ["Total Debit Amount", "Total Amount to Debit", "Total Amount (MYR)", "Total Amount (RM)", "Total Debit"]
TOTAL_FEE = ["Total Fee Charges", "Total Fee Charge", "Total Charges", "Total Charge"]
FEE = ["SMS Fee", "SMS Fees", "Service Tax Charges", "Service Tax Charge", "Service Charges", "Service Charge", "Fund Transfer Charges", "Fund Transfer Charge", "Processing Fee", "Processing Fees", "Handling Fee", "Handling Fees", "Bank Charges", "Bank Charge", "Transaction Fee", "Transaction Fees", "Transfer Fee", "Transfer Fees", "Tax Amount", "GST Amount", "SST Amount", "Remittance Commission", "Commission", "Stamp Duty", "Levy", "GST", "SST", "Fee", "Fees", "Charges", "Charge"]
AMOUNT = ["Transaction Amount", "Transfer Amount", "Payment Amount", "Remittance Amount", "Debit Amount", "Gross Amount", "Net Amount", "Total Amount", "Invoice Total", "Debit Amt", "Payment Advice Amount"]
# Scores of money by how it was found, and how far it may stand from its label.
SCORE = {"block": 98, "strong": 97, "weak": 90, "above": 85, "currency": 65, "fee": 90, "fee_block": 95, "debit": 90, "debit_block": 95}
AFTER, AFTER_FEE, CURRENCY_NEAR, ABOVE, RUN_GAP, CHAIN, CHAIN_GAP = 300, 150, 25, 60, 60, 1000, 25
# Labels of dates, and of stamps that are never the transaction's date.
DATE_FIRST = ["Transaction Date", "Date and Time", "Value Date", "Transfer Date", "Payment Date", "Debit Date", "Creation Date", "Today"]
DATE_SECOND = ["Advice Date", "Created Date & Time", "Created Date and Time", "Created Date Time", "Created Date", "Approve Date", "Approved Date", "Approval Date", "Approved Time", "Approval Time", "Approval Timestamp", "Approved", "Approval", "Authorise Date", "Authorised Date", "Authorisation Date", "Authorisation Time", "Authorization Date", "Authorization Time", "Statement Period", "Statement Date"]
DATE_NEVER = ["Printed Date/Time", "Printed Date Time", "Printed On", "Generated on", "Date of Export", "Computer generated"]
DATE_AFTER, NEVER_BEFORE = 350, 40
# Labels of the parties with their confidence in thousandths, in order.
PAYER = {"Ordering Customer Account Name": 970, "Remitter Name": 970, "Remitter's Name": 970, "Debit Acct Name": 960, "Debit Account Name": 960, "Sender Name": 960, "Applicant Name": 950, "Account Name": 880, "Company Name": 880, "From Account Name": 950, "Your Account": 900, "Debit Acct No": 850, "Source Account": 900, "Debit From Account No": 900, "From Account": 850, "Ordering Customer": 900, "Ordering Party": 950, "Contact Name": 880, "Payer/Payee": 920, "Payer": 900, "Remitter": 950, "Applicant": 800}
BENEFICIARY = {"Beneficiary Name": 970, "Recipient Name": 960, "Payee Account Name": 960, "Payee Name": 950, "Payee Nickname": 900, "Payee's Nickname": 900, "Transfer To": 900, "To DuitNow ID/Account Number": 880, "Recipient's DuitNow ID/Account No": 880, "DuitNow ID": 800, "Payee/Payee": 850, "Credit Account": 850, "Name and Addr": 850}
ORGANISATIONS = "SDN BHD, SDN. BHD, SDN, BHD, BERHAD, PTE, LTD, LIMITED, ENTERPRISE, TRADING, LOGISTICS, SHIPPING, HOLDINGS, GROUP, CORPORATION, CORP, INC".split(", ")
# Words of which labels are made; a party's name isn't made of them alone.
LABEL_WORDS = "Transaction, Transfer, Payment, Beneficiary, Recipient, Payee, Payer, Account, Bank, Debit, Credit, Value, Applicant, Ordering, Customer, Source, Destination, Instruction, Additional, Reference, Service, Product, Status, Charges, Charge, Fee, Amount, Currency, Date, Details, Detail, Mode, Type, Name, Number, No, Business, Registration, Registrati, DuitNow, ID, Nickname, Residency, Resident, Information, Approval, Purpose, Remark, Note, Total, Validate, Favourite, Channel, Batch, Import, Advice, Message, Email, Telephone, Fax".split(", ")
CURRENCIES = ["MYR", "RM", "USD", "SGD", "EUR", "GBP", "AUD", "JPY", "CNY", "HKD"]
# Payment modes: names that are printed, and what is reported; the first that is found counts.
MODES = {"Interbank GIRO": "Interbank GIRO (IBG)", "IBG": "Interbank GIRO (IBG)", "DuitNow (Transfer)": "DuitNow Transfer", "DuitNow Transfer": "DuitNow Transfer", "DuitNow Payment": "DuitNow Payment", "DuitNow": "DuitNow", "Outward ACH": "Outward ACH", "Inward ACH": "Inward ACH", "ACH Credit/GIRO": "ACH Credit/GIRO", "ACH Credit GIRO": "ACH Credit/GIRO", "Automated Clearing House (ACH)": "ACH", "Instant Transfer": "Instant Transfer", "Immediate Transfer": "Immediate Transfer", "RENTAS": "RENTAS", "Fund Transfer": "Fund Transfer", "Funds Transfer": "Fund Transfer", "GIRO": "Interbank GIRO (IBG)"}
MODE_LABELS = ["Payment Mode", "Product Type", "Payment Type", "Transfer Mode", "Transaction Type", "Service", "Services", "Payment Method", "Transfer Type", "Financial Txn Type"]
MODE_AFTER = 120
# Company forms that say nothing about who a party is.
COMPANY_FORMS = "SDN, BHD, BERHAD, PTE, LTD, LIMITED, COMPANY, CO, INC, CORP, CORPORATION, GROUP, HOLDINGS, ENTERPRISE, MALAYSIA, M".split(", ")
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "oct", "october", "november", "december", "sept", *MONTHS]
# End of fixed values.


def registry_rows() -> list[dict]:
    """The registry: key, name, bic, names (in capitals, the printed one first), tier, parent."""
    out = []
    for line in REGISTRY_TEXT.strip().splitlines():
        # A name may hold bars itself; fields are told by the blanks around them.
        key, name, bic, names, tier, parent = (x.strip() for x in re.split(r"\s\|(?=\s|$)", line.strip()))
        out.append({"key": key, "name": name, "bic": bic or None, "names": list(dict.fromkeys([name.upper(), *[n for n in names.split(", ") if n]])), "tier": tier, "parent": parent or None})
    return out


def reference_key(label: str) -> str:
    """What is left of a label when spelling is: the same rule as references.key_of."""
    x = re.sub(r"[ \t]*\([^)]*\)$", "", label.lower()) if label.lower().startswith("end") else label.lower()
    x = re.sub(r"[^a-z0-9]", "", re.sub("['’`´]s", "", x).replace("reference", "ref"))
    return re.sub(r"(number|no|id)$", "", x)


def reference_labels() -> dict[str, tuple[str, str]]:
    """key: (reported name, role)."""
    return {reference_key(x): (names[0], role) for role, many in REFERENCE_LABELS.items() for names in many for x in names}


NUMBER = r"(?:Number|No\.?|ID)"


def _label_pattern(name: str, required: bool) -> str:
    base = re.sub(r"\s+(?:Number|No\.?|no|ID)$", "", name.strip())
    parts = []
    for word in re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9.]", base):
        if word.lower() in ("ref", "reference"):
            parts.append(r"Ref(?:erence)?\.?")
        else:
            parts.append(re.escape(word) + (r"(?:['’`´]s)?" if word == "Recipient" else ""))
    tail = rf"[ \t]*{NUMBER}" if required else rf"(?:[ \t]*{NUMBER}(?![A-Za-z0-9]))?" if not name.endswith("ID") else r"[ \t]*ID(?:[ \t]*\([^)\n]*\))?"
    return r"[ \t]*".join(parts) + tail


def reference_pattern() -> str:
    """All labels of references; of those that start at one place the longest comes first."""
    every = [(x, x in NEED_NUMBER) for many in REFERENCE_LABELS.values() for names in many for x in names]
    # Labels are told apart by their first letter, so that a scan fails early; within a letter the order holds.
    by_letter: dict[str, list[str]] = {}
    for x, need in sorted(every, key=lambda p: (p[1] and p[0] == "Reference No", -len(p[0]))):
        by_letter.setdefault(x[0].upper(), []).append(_label_pattern(x, need)[1:])
    ways = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return r"(?i:" + starting("".join(by_letter), r"(?<![A-Za-z0-9])(?:" + ways + r")(?![A-Za-z0-9]))")


def any_of(names: list[str], blank: str) -> str:
    """A pattern of names, in capitals, with common beginnings written once, so that a scan fails early; the longest match first.

    Names are words with one blank between; `blank` is the pattern that a blank stands for.
    """
    tree: dict = {}
    for name in names:
        at = tree
        for c in name.upper():
            at = at.setdefault(blank if c == " " else re.escape(c), {})
        at[""] = {}

    def write(node: dict) -> str:
        ways = [c + write(sub) for c, sub in node.items() if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return body + ("?" if "" in node else "")

    return "(?:" + write(tree) + ")"


def phrases(names: list[str]) -> str:
    """A pattern of phrases, blanks between words being optional, as a group without capture."""
    return any_of([" ".join(re.findall(r"[A-Za-z0-9'’.]+|[^\sA-Za-z0-9'’.]", p)) for p in names], r"[ \t]*")


def labels(names: list[str], tail: str = "") -> str:
    """A pattern of phrases as whole words, capitals aside, for scans."""
    return r"(?i:" + starting("".join(n[0] for n in names), r"(?<![A-Za-z0-9])" + phrases(names) + tail + r"(?![A-Za-z0-9]))")
