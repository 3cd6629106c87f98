"""Public suffixes of two labels, under which names are registered; any other suffix is the last label.

The second levels that several country domains share, and all of ten large ones, as of the public
suffix list; hosting services whose customers have subdomains; and the reserved example domains,
where the synthetic tables register theirs. City and wildcard rules aren't included: pass a full list
where it is at hand.
"""

from __future__ import annotations

SECOND_LEVELS = """
    ac: com edu gov net mil org
    ad: nom
    ae: co net org sch ac gov mil
    aero: press
    af: gov com org net edu
    ag: com org net co nom
    ai: com net org
    al: com edu gov mil net org
    am: co com net org
    ao: ed co
    ar: com coop edu gob gov int mil net org
    as: gov
    at: ac co or
    au: com net org edu gov asn id info conf oz act nsw nt qld sa tas vic wa
    aw: com
    az: com net int gov org edu info mil name pro biz
    ba: com edu gov mil net org
    bb: biz co com edu gov info net org store tv
    be: ac
    bf: gov
    bh: com edu net org gov
    bi: co com edu or org
    bj: co com edu info net org
    bm: com edu gov net org
    bn: com edu gov net org
    bo: com edu gob int org net mil tv web info
    br: 9guacu abc adm adv agr aju am anani aparecida app arq art ato b barueri belem bhz bib bio blog bmd boavista bsb campinagrande campinas caxias cim cng cnt com contagem coop coz cri cuiaba curitiba def des det dev ecn eco edu emp enf eng esp etc eti far feira flog floripa fm fnd fortal fot foz fst g12 geo ggf goiania gov gru imb ind inf jab jampa jdf joinville jor jus leg lel log londrina macapa maceio manaus maringa mat med mil morena mp mus natal net niteroi not ntr odo ong org osasco palmas poa ppg pro psc psi pvh qsl radio rec recife rep ribeirao rio riobranco riopreto salvador sampa santamaria santoandre saobernardo saogonca seg sjc slg slz sorocaba srv taxi tc tec teo the tmp trd tur tv udi vet vix vlog wiki zlg
    bs: com net org edu gov
    bt: com edu gov net org
    bw: co org
    by: gov mil com
    bz: com net org edu gov
    cd: gov
    ci: org or com co edu ed ac net go asso int gouv
    cl: co gob gov mil
    cm: co com gov net
    cn: ac com edu gov net org mil sc
    co: arts com edu firm gov info int mil net nom org rec web
    cr: ac co ed go or
    cu: com edu org net gov
    cv: com edu int org
    cw: com edu net org
    cx: gov
    cy: ac biz com gov mil net org press pro tm
    dm: com net org edu gov
    do: art com edu gob gov mil net org web
    dz: art asso com edu gov org net tm
    ec: com info net med pro org edu gov gob mil
    ee: edu gov med com org
    eg: com edu gov mil name net org
    es: com nom org gob edu
    et: com gov org edu biz name info net
    fj: ac biz com gov info mil name net org pro
    fm: com edu net org
    fr: asso com gouv nom tm
    gd: edu gov
    ge: com edu gov org mil net
    gg: co net org
    gh: com edu gov org mil
    gi: com gov edu org
    gl: co com edu net org
    gn: ac com edu gov org net
    gp: com net mobi edu org asso
    gr: com edu net org gov
    gt: com edu gob ind mil net org
    gu: com edu gov info net org web
    gy: co com edu gov net org
    hk: com edu gov net org
    hn: com edu org net mil gob
    hr: name com
    ht: com firm info net pro org med art coop asso edu gouv
    hu: co info org tm
    id: ac biz co go mil net or sch web
    ie: gov
    il: ac co gov idf k12 muni net org
    im: ac co com net org tv
    in: 5g 6g ac ai am bihar biz business ca cn co com coop cs delhi dr edu er firm gen gov gujarat ind info int internet io me mil net nic org pg post pro res travel tv uk up us
    io: com
    iq: gov edu mil com org net
    ir: ac co gov id net org sch
    is: net com edu gov org int
    it: gov edu co go me or tv
    je: co net org
    jo: com org net edu sch gov mil name
    jp: ac co ed go ne or
    ke: ac co go info me mobi ne or sc
    kg: org net com edu gov mil
    ki: edu biz net org gov info com
    km: org nom gov tm edu mil com coop asso gouv
    kn: net org edu gov
    kp: com edu gov org
    kr: ac co es go hs kg mil ms ne or pe re sc busan chungbuk chungnam daegu daejeon gangwon gwangju gyeongbuk gyeonggi gyeongnam incheon jeju jeonbuk jeonnam seoul ulsan
    kw: com edu gov ind net org
    ky: com edu net org
    kz: org edu net gov mil com
    la: int net info edu gov com org
    lb: com edu gov net org
    lc: com net co org edu gov
    lk: gov sch net int com org edu web ac
    lr: com edu gov org net
    ls: ac biz co edu gov info net org sc
    lt: gov
    lv: com edu gov org mil id net
    ly: com net gov edu sch med org id
    ma: co net gov org ac press
    mc: tm asso
    me: co net org edu ac gov
    mg: org nom gov tm edu mil com co
    mk: com org net edu gov name
    ml: com edu gouv gov net org
    mn: gov edu org
    mo: com net org edu gov
    mr: gov
    ms: com edu gov net org
    mt: com edu net org
    mu: com net org gov ac co or
    museum: art arts press
    mv: biz com coop edu gov info int mil museum name net org pro
    mw: ac biz co com coop edu gov int museum net org
    mx: com org gob edu net
    my: biz com edu gov mil name net org
    mz: ac co edu gov mil net org
    na: info pro name or in tv mobi co com org
    nc: asso nom
    nf: com net rec web arts firm info store
    ng: com edu gov mil mobi name net org sch
    ni: ac biz co com edu gob in info int mil net nom org web
    no: museum mil tm
    nr: biz info gov edu org net com
    nz: ac co cri geek gen govt health iwi kiwi maori mil net org parliament school
    om: co com edu gov med museum net org pro
    pa: ac gob com org edu net med nom
    pe: edu gob nom mil org com net
    pf: com org edu
    ph: com net org gov edu mil
    pk: com net edu org biz web gov gob info
    pl: com net org biz edu info mil nom tm gov
    pn: gov co org edu net
    pr: com net org gov edu pro biz info name ac
    pro: med
    ps: edu gov com org net
    pt: net gov org edu int com
    pw: co ne or ed go
    py: com coop edu gov mil net org
    qa: com edu gov mil name net org sch
    re: asso com nom
    ro: arts com firm info nom org rec store tm
    rs: ac co edu gov in org
    rw: ac co coop gov mil net org
    sa: com net org gov med edu sch
    sb: com edu gov net org
    sc: com gov net org edu
    sd: com net org edu med tv gov info
    se: ac org press tm
    sg: com net org gov edu
    sh: com net gov org mil
    sl: com net edu gov org
    sn: art com edu gouv org
    so: com edu gov me net org
    ss: biz com edu gov me net org sch
    st: co com edu mil net org store
    sv: com edu gob org
    sx: gov
    sy: edu gov net mil com org
    sz: co ac org
    th: ac co go in mi net or
    tj: ac biz co com edu go gov int mil name net org web
    tl: gov
    tm: com co org net nom gov mil edu
    tn: com gov ind info net org
    to: com gov net org edu mil
    tr: av bbs bel biz com dr edu gen gov info mil k12 kep name net org pol tel tsk tv web nc
    tt: co com org net biz info pro int coop mobi museum name gov edu
    tw: edu gov mil com net org
    tz: ac co go info me mil mobi ne or sc tv
    ua: com edu gov in net org
    ug: co or ac sc go ne com org
    uk: ac co gov ltd me net nhs org plc police
    us: co id in me ne or sc
    uy: com edu mil net org
    uz: co com net org
    vc: com net org gov mil edu
    ve: arts co com edu firm gob gov info int mil net nom org rec store web
    vi: co com net org
    vn: com net org edu gov int ac biz info name pro
    vu: com edu net org
    ws: com net org gov edu
    ye: com edu gov net mil org
    za: ac agric alt co edu gov grondar law mil net ngo nic nis nom org school tm web
    zm: ac biz co com edu gov info mil net org sch
    zw: ac co gov mil org
"""
HOSTING = "github.io gitlab.io blogspot.com herokuapp.com pages.dev workers.dev netlify.app vercel.app web.app firebaseapp.com azurewebsites.net cloudfront.net"
RESERVED = "example.com example.net example.org"

SUFFIXES = (
    *(f"{name}.{top.strip()}" for top, names in (line.split(":") for line in SECOND_LEVELS.strip().splitlines()) for name in names.split()),
    *HOSTING.split(),
    *RESERVED.split(),
)
